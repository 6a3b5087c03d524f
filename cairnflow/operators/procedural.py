"""Order-dependent text operators that built-in expressions do not hold: chunkers, packers, extractors, bounded edits.

Each is a plain Python function over one text (or one group's rows in order) and an Arrow-batched operator around it, so a
text never leaves its task. Packing (C15, C16) is in ``chains``; ``packs`` is its rule over one list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..registry import query
from . import chains as C

MOST_CHARS, LEAST_CHARS, OVERLAP_CHARS = 2000, 30, 200
CODE_CHARS, CODE_TAIL, CODE_HARD = 2400, 80, 4


#: Texts whose results a Python worker holds at once.
AT_ONCE = 200


def per_text(rows: DataFrame, key: str, text: str, schema: str, f: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows (key, ...) that ``f`` gives for each text; null texts give none."""
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                keys, cols = [], [[] for _ in names]
                for k, x in zip(part.column(0).to_pylist(), part.column(1)):
                    for row in f(x.as_py()) if x.is_valid else ():
                        keys.append(k)
                        for c, v in zip(cols, row):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *[pa.array(c, kinds[n]) for c, n in zip(cols, names)]], [key, *names])

    kinds = {n: {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[part.strip().split()[1]] for n, part in zip(names, schema.split(","))}
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, {schema}")


# -- Markdown ------------------------------------------------------------------

_HEADING = re.compile(r"^(#{1,4})\s+(.*\S)\s*$")


def front_matter(text: str) -> tuple[dict[str, str | list[str]], str]:
    """C4: the ``key: value`` lines (lists in brackets) between two ``---`` lines at the start, and the rest."""
    m = re.match(r"---\n(.*?)\n---\n?", text, re.S)
    if not m:
        return {}, text
    found: dict[str, str | list[str]] = {}
    for line in m[1].split("\n"):
        if line.lstrip().startswith("#") or ":" not in line:
            continue
        key, _, value = line.partition(":")
        value = value.strip()
        plain_ = [v.strip().strip("\"'") for v in value[1:-1].split(",")] if value[:1] == "[" and value[-1:] == "]" else value.strip("\"'")
        found[key.strip()] = [v for v in plain_ if v] if isinstance(plain_, list) else plain_
    return found, text[m.end() :]


def paragraphs(text: str, most: int = MOST_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Pieces of whole paragraphs up to ``most`` characters; each but the first starts with the end of the one before it."""
    out, now = [], ""
    for p in re.split(r"\n\s*\n", text):
        for part in [p[i : i + most] for i in range(0, len(p), most)] or [""]:
            if now and len(now) + 2 + len(part) > most:
                out.append(now)
                tail = now[-overlap:]
                now = f"(continued from: {tail})\n\n{part}"
            else:
                now = f"{now}\n\n{part}" if now else part
    return [*out, now] if now.strip() else out


def markdown_chunks(text: str) -> list[tuple[int, str | None, str]]:
    """(index, heading, content) of sections at headings of level 1 to 4, long ones in paragraphs, short ones dropped."""
    _, body = front_matter(text)
    body = re.sub(r"\[\[[^\]|]*\|([^\]]*)\]\]", r"\1", body)
    body = re.sub(r"\[\[(?:[^\]/]*/)*([^\]/]*)\]\]", r"\1", body)
    sections: list[tuple[str | None, list[str]]] = [(None, [])]
    fenced = False
    for line in body.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else _HEADING.match(line)
        if m:
            sections.append((m[2], [line]))
        else:
            sections[-1][1].append(line)
    out = []
    for heading, lines in sections:
        content = "\n".join(lines).strip()
        if len(content) >= LEAST_CHARS:
            out += [(heading, part) for part in (paragraphs(content) if len(content) > MOST_CHARS else [content])]
    return [(i, h, c) for i, (h, c) in enumerate(out)]


def sections(text: str) -> list[tuple[str | None, int, str]]:
    """(heading, first line from 1, text) at level-2 headings, what comes before them first."""
    out: list[tuple[str | None, int, list[str]]] = [(None, 1, [])]
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"##\s+(.*\S)", line)
        if m:
            out.append((m[1], n, []))
        else:
            out[-1][2].append(line)
    return [(h, n, "\n".join(ls)) for h, n, ls in out if h or "\n".join(ls).strip()]


# -- code ------------------------------------------------------------------


def masked_code(text: str, python: bool = False) -> str:
    """The text with the insides of strings and comments blanked, so that braces in them do not count; its length stays."""
    rule = r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*' if python else r'/\*(?:.|\n)*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
    return re.sub(rule, lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_SYMBOL = re.compile(r"^\s*(?:export\s+|public\s+|private\s+|static\s+|async\s+|default\s+)*(?:function|class|interface|def|func|fn|struct|enum|type|const)\s+\*?([A-Za-z_]\w*)", re.M)


def code_chunks(text: str, python: bool = False) -> list[tuple[int, int, int, list[str], str]]:
    """(index, first line, last line, symbols, code) of top-level units packed to CODE_CHARS; a short tail joins the chunk
    before it, and a unit over CODE_HARD times the size is cut by lines."""
    lines, mask = text.split("\n"), masked_code(text, python).split("\n")
    units, depth, now = [], 0, []
    for i, m in enumerate(mask):
        starts = bool(m[:1].strip()) if python else depth == 0 and bool(m.strip())
        if now and starts and (not python or _SYMBOL.match(m) or re.match(r"@|if |for |with ", m)):
            units.append(now)
            now = []
        now.append(i)
        if not python:
            depth = max(0, depth + sum(m.count(c) for c in "{([") - sum(m.count(c) for c in "})]"))
    if now:
        units.append(now)
    size = lambda ids: sum(len(lines[i]) + 1 for i in ids)
    cut = []
    for u in units:
        if size(u) <= CODE_HARD * CODE_CHARS:
            cut.append(u)
            continue
        part = []
        for i in u:
            if part and size(part) + len(lines[i]) > CODE_CHARS:
                cut.append(part)
                part = []
            part.append(i)
        cut.append(part)
    packed: list[list[int]] = []
    for u in cut:
        if packed and size(packed[-1]) + size(u) <= CODE_CHARS:
            packed[-1] = packed[-1] + u
        else:
            packed.append(list(u))
    if len(packed) > 1 and size(packed[-1]) < CODE_TAIL:
        packed[-2:] = [packed[-2] + packed[-1]]
    out = []
    for u in packed:
        code = "\n".join(lines[i] for i in u)
        if code.strip():
            out.append((len(out), u[0] + 1, u[-1] + 1, _SYMBOL.findall("\n".join(mask[i] for i in u)), code))
    return out


def comments(text: str, python: bool = False) -> list[tuple[int, int, str]]:
    """(first line, last line, prose) of comments, neighbouring line comments as one."""
    rule = r'^[ \t]*#(?P<line>[^\n]*)|"""(?P<block>(?:.|\n)*?)"""' if python else r"//(?P<line>[^\n]*)|/\*(?P<block>(?:.|\n)*?)\*/"
    found: list[tuple[int, int, str, bool]] = []
    for m in re.finditer(rule, text, re.M):
        first = text.count("\n", 0, m.start()) + 1
        block = m["block"] is not None
        said = " ".join(re.sub(r"^\s*\*?\s?", "", x).strip() for x in (m["block"] if block else m["line"]).split("\n")).strip()
        if not block and found and not found[-1][3] and found[-1][1] == first - 1:
            a, _, before, _ = found.pop()
            found.append((a, first, f"{before} {said}".strip(), False))
        else:
            found.append((first, first + m[0].count("\n"), said, block))
    return [(a, b, s) for a, b, s, _ in found if s]


def imports(text: str) -> list[tuple[int, str, str]]:
    """(line, language, package) of Python and JavaScript imports; scoped packages keep two parts, relative ones go."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*(?:from\s+([A-Za-z_][\w.]*)\s+import\b|import\s+([A-Za-z_][\w.]*)(?:\s+as\s+\w+)?\s*$)", line):
            out.append((n, "python", (m[1] or m[2]).split(".")[0]))
        elif m := re.search(r"""(?:\bfrom\s+|\brequire\(\s*|^\s*import\s+)["']([^"'\n]+)["']""", line):
            if not m[1].startswith("."):
                out.append((n, "javascript", "/".join(m[1].split("/")[: 2 if m[1][0] == "@" else 1])))
    return out


def infra_markers(text: str) -> list[tuple[str, str]]:
    """(kind, name) of base images, workflow actions and Terraform resources; tags and digests are dropped, and a kind that occurs has a marker row."""
    found = [("image", m.split("@")[0].rsplit("/", 1)[-1].split(":")[0]) for m in re.findall(r"(?im)^\s*FROM\s+(\S+)", text)]
    found += [("action", m.split("@")[0].rsplit("/", 1)[-1]) for m in re.findall(r"(?m)^\s*-?\s*uses:\s*([\w./-]+@\S+)", text)]
    found += [("resource", m) for m in re.findall(r'(?m)^\s*resource\s+"([a-z0-9_]+)"', text)]
    out = list(dict.fromkeys(found))
    return out + [("marker", k) for k in dict.fromkeys(k for k, _ in out)]


def arns(text: str) -> list[tuple[str, str]]:
    """(service, arn), the first of each service; placeholder accounts are skipped."""
    out: dict[str, str] = {}
    for m in re.finditer(r"arn:aws:([a-z0-9-]+):[a-z0-9-]*:([0-9]{12}|):[\w/.:*-]+", text):
        if m[2] not in ("000000000000", "123456789012"):
            out.setdefault(m[1], m[0])
    return list(out.items())


# -- YAML -----------------------------------------------------------------------


def _scalar(text: str):
    """A plain, quoted or flow scalar; numbers and booleans stay text, as only strings are looked at."""
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    text = re.split(r"\s#", text, maxsplit=1)[0].strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return None if text in ("", "~", "null") else text


_PAIR = re.compile(r"""((?:"[^"]*"|'[^']*'|[^\s#'"\[\]{}&*!|>][^:#]*?|[^\s:]+?))\s*:(?:\s+(.*))?$""")


def _yaml_block(lines: list[tuple[int, str]], at: int, indent: int):
    """(value, next line) of the block that starts at a line of this indentation."""
    if lines[at][1].startswith(("- ", "-\n")) or lines[at][1] == "-":
        out = []
        while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
            rest = lines[at][1][1:]
            inner = indent + 1 + len(rest) - len(rest.lstrip())
            if not rest.strip():
                at += 1
                value = None
                if at < len(lines) and lines[at][0] > indent:
                    value, at = _yaml_block(lines, at, lines[at][0])
            elif _PAIR.match(rest.strip()) and rest.strip()[:1] not in "\"'[{":
                lines[at] = (inner, rest.strip())
                value, at = _yaml_block(lines, at, inner)
            else:
                value, at = _scalar(rest), at + 1
            out.append(value)
        return out, at
    out = {}
    while at < len(lines) and lines[at][0] == indent:
        m = _PAIR.match(lines[at][1])
        if not m:
            raise ValueError(f"no YAML mapping: {lines[at][1]!r}")
        key, rest = str(_scalar(m[1])), (m[2] or "").strip()
        at += 1
        if rest[:1] in ("|", ">"):
            held = []
            while at < len(lines) and (lines[at][0] > indent):
                held.append(lines[at][1])
                at += 1
            out[key] = ("\n" if rest[0] == "|" else " ").join(held)
        elif rest and not rest.startswith("#"):
            out[key] = _scalar(rest)
        elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
            out[key], at = _yaml_block(lines, at, lines[at][0])
        else:
            out[key] = None
    return out, at


def yaml_documents(text: str) -> list:
    """The documents of a YAML text as mappings, lists and strings: block style, quoted scalars, block scalars and flow lists; raises ValueError on others."""
    out = []
    for part in re.split(r"(?m)^---.*$", text):
        lines, block = [], None
        for line in part.split("\n"):
            bare = line.lstrip(" ")
            if not bare.strip():
                continue
            if bare.startswith("#") and (block is None or len(line) - len(bare) <= block):
                continue
            if block is not None and len(line) - len(bare) <= block:
                block = None
            if block is None and re.search(r":\s+[|>][+-]?\s*$", bare):
                block = len(line) - len(bare)
            lines.append((len(line) - len(bare), bare.rstrip()))
        if lines:
            value, end = _yaml_block(lines, 0, lines[0][0])
            if end < len(lines):
                raise ValueError(f"no YAML: {lines[end][1]!r}")
            out.append(value)
    return out


def _nested(node) -> Iterator[tuple[str | None, object]]:
    """Every (key, value) below a node, list members without a key."""
    for k, v in node.items() if isinstance(node, dict) else ((None, x) for x in node) if isinstance(node, list) else ():
        yield k, v
        yield from _nested(v)


def _kind_fact(kind: str) -> list[tuple[str, str]]:
    """What a kind of manifest says by its name: roles and their bindings are access control, policies name themselves."""
    if kind.removesuffix("Binding").endswith("Role"):
        return [("iac", "k8s_rbac")]
    return [("iac", f"k8s_{kind.lower()}")] if kind.endswith("Policy") else []


def _annotation_fact(key: str, known: dict[str, str]) -> list[tuple[str, str]]:
    """What an annotation names: a caller's name for its prefix, else a vendor's service by the host it begins with."""
    named = [name for prefix, name in known.items() if key.startswith(prefix)]
    host = key.partition("/")[0].split(".")
    if not named and "/" in key and host[-2:] == ["amazonaws", "com"] and len(host) > 2:
        named = [f"aws_{host[-3]}"]
    return [("k8s-annotation", n) for n in named]


def manifest_facts(text: str, annotations: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(ecosystem, name) facts of Kubernetes manifests, which are documents with an apiVersion and a kind: the platform once, access control and
    policies once, an image's bare name for each image, what annotations name (``annotations``: names by prefix), and services of ARNs in any
    string; none where the text is no YAML."""
    try:
        manifests = [d for d in yaml_documents(text) if isinstance(d, dict) and d.get("apiVersion") and isinstance(d.get("kind"), str)]
    except ValueError:
        return []
    once: dict[tuple[str, str], None] = {}
    images = []
    for d in manifests:
        once.update(dict.fromkeys([("iac", "kubernetes"), *_kind_fact(d["kind"])]))
    for d in manifests:
        for k, v in _nested(d):
            if k == "metadata" and isinstance(v, dict) and isinstance(v.get("annotations"), dict):
                once.update(dict.fromkeys(fact for key in v["annotations"] for fact in _annotation_fact(key, annotations or {})))
            elif isinstance(v, str):
                once.update(dict.fromkeys(("aws", service) for service, _ in arns(v)))
                images += [("docker", v.partition("@")[0].rpartition("/")[2].partition(":")[0])] * (k == "image")
    return [*once, *images]


#: Words in a step of a pipeline that say that it deploys, unless a caller has others.
DEPLOY_WORDS = frozenset(("deploy", "deployment", "rollout", "release", "upgrade", "apply"))


def is_pipeline(path: str, samples: frozenset[str] = frozenset(("test", "tests", "fixtures", "examples", "samples"))) -> bool:
    """Whether a path is that of a pipeline: YAML in a folder of workflows, or a hidden file named for its CI; not among samples."""
    *folders, name = path.lower().split("/")
    if samples & set(folders):
        return False
    stem, _, kind = name.rpartition(".")
    return name == "jenkinsfile" or kind in ("yml", "yaml") and ("workflows" in folders or name[0] == "." and "ci" in re.split("[^a-z]+", stem))


def workflow_concepts(path: str, text: str, words: frozenset[str] = DEPLOY_WORDS) -> list[tuple[str, str, float]]:
    """(concept, detector, confidence), one row a detector: a pipeline that declares jobs or stages, and one that deploys in a step (a line of it
    that is no comment holds one of ``words``)."""
    if not is_pipeline(path):
        return []
    try:
        documents = yaml_documents(text)
    except ValueError:
        return []
    if len(documents) != 1 or not isinstance(documents[0], dict) or not {"jobs", "stages"} & set(documents[0]):
        return []
    lines = (line.strip().lower() for k, v in _nested(documents[0]) if k in ("run", "uses") and isinstance(v, str) for line in v.split("\n"))
    deploys = any(words & set(re.split("[^a-z]+", line)) for line in lines if not line.startswith("#"))
    return [("continuous integration", "pipeline", 1.0)] + [("continuous delivery", "deployment", 1.0)] * deploys


# -- manifests ------------------------------------------------------------------


def dependencies(name: str, text: str) -> list[tuple[str, str, str | None]]:
    """(ecosystem, package, version) of a manifest by its file name; what can't be parsed gives none."""
    name = name.rsplit("/", 1)[-1]
    if name in ("package.json", "composer.json"):
        keys, eco = (("dependencies", "devDependencies"), "npm") if name == "package.json" else (("require", "require-dev"), "composer")
        try:
            data = json.loads(text)
        except ValueError:
            return []
        return [(eco, k, str(v)) for part in keys for k, v in (data.get(part) or {}).items()] if isinstance(data, dict) else []
    if name == "go.mod":
        return [("go", m[1], m[2]) for m in re.finditer(r"^\s*(?:require\s+)?([\w.-]+(?:/[\w.-]+)+)\s+(v[\w.+-]+)", text, re.M)]
    if name == "Gemfile":
        return [("gem", m[1], m[2]) for m in re.finditer(r"""^\s*gem\s+["']([\w-]+)["'](?:\s*,\s*["']([^"']+)["'])?""", text, re.M)]
    if name.startswith("requirements") and name.endswith(".txt"):
        return [("pypi", m[1].lower(), m[2]) for m in re.finditer(r"^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~><!]=?=?\s*([\w.*]+))?", text, re.M)]
    if name in ("pyproject.toml", "Cargo.toml"):
        import tomllib

        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return []
        if name == "Cargo.toml":
            return [("cargo", k, v if isinstance(v, str) else v.get("version")) for k, v in data.get("dependencies", {}).items()]
        return [("pypi", m[1].lower(), m[2]) for d in data.get("project", {}).get("dependencies", []) if (m := re.match(r"([\w.-]+)(?:\[[^\]]*\])?\s*(?:[=~><!]=?\s*([\w.*]+))?", d))]
    return []


# -- packing ------------------------------------------------------------------


def packs(sizes: list[int], most_items: int, most_chars: int) -> list[int]:
    """The pack of each item, in order: a pack ends at ``most_items`` or ``most_chars``; a larger item is alone."""
    out, pack, items, chars = [], 0, 0, 0
    for n in sizes:
        if items and (items >= most_items or chars + n > most_chars):
            pack, items, chars = pack + 1, 0, 0
        out.append(pack)
        items, chars = items + 1, chars + n
    return out


# -- bounded edits ------------------------------------------------------------------


def without_unknown_numbers(text: str, allowed: set[str], passes: int = 3) -> str:
    """H9: numbers that are not allowed go with the phrase of their unit, else alone; at most ``passes`` rounds."""
    for _ in range(passes):
        new = re.sub(r"(?<![\w.])(?:by |of |over |to )?[~$€]?(\d+(?:[.,]\d+)*)(?:\s?(?:%|percent|ms|x|k|users|requests|hours))?", lambda m: m[0] if m[1] in allowed else "", text)
        new = re.sub(r"[ \t]{2,}", " ", new)
        if new == text:
            break
        text = new
    return text


def near_phrase(term: str, text: str, window: int = 12) -> bool:
    """M2: the padded phrase, or all of at least two tokens within ``window`` words of one sentence."""
    want = re.findall("[a-z0-9]+", term.lower())
    if not want:
        return False
    low = text.lower()
    if not all(w in low for w in want):  # most texts lack one of the tokens, and no part of them need be cut up
        return False
    for sentence in re.split(r"[.!?\n]+", low):
        words = re.findall("[a-z0-9]+", sentence)
        if f" {' '.join(want)} " in f" {' '.join(words)} ":
            return True
        if len(want) < 2:
            continue
        last: dict[str, int] = {}
        for i, w in enumerate(words):
            if w in want:
                last[w] = i
                if len(last) == len(set(want)) and i - min(last.values()) < window:
                    return True
    return False


@query("C2_markdown_chunks")
def _(t):
    text = t.documents.selectExpr("doc_id", "concat('## ', source, '\\n', text, '\\n\\n### more\\n', substring(text, 1, 300)) text")
    return per_text(text, "doc_id", "text", "chunk_index int, heading string, content string", markdown_chunks)


@query("C7_code_chunks")
def _(t):
    return per_text(t.pages, "page_id", "html", "chunk_index int, first_line int, last_line int, symbols array<string>, code string", code_chunks)


def packs_sql(rows: str, most_items: int, most_chars: int) -> str:
    """DuckDB SQL of the packing rule, one row after the other, over (g, o, size): group, order and size."""
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o) AS pos FROM ({rows})),
    walk AS (SELECT g, o, size, pos, 0::BIGINT AS pack, 1 AS items, size AS chars FROM r WHERE pos = 1
      UNION ALL SELECT g, o, size, pos, CASE WHEN full_ THEN pack + 1 ELSE pack END, CASE WHEN full_ THEN 1 ELSE items + 1 END, CASE WHEN full_ THEN size ELSE chars + size END
      FROM (SELECT r.*, w.pack, w.items, w.chars, w.items >= {most_items} OR w.chars + r.size > {most_chars} AS full_ FROM walk w JOIN r ON r.g IS NOT DISTINCT FROM w.g AND r.pos = w.pos + 1))"""


@query("C16_packs", packs_sql("SELECT conv_id AS g, turn AS o, COALESCE(length(text), 0) + 4 AS size FROM conversations", 4, 1200) + " SELECT g AS conv_id, o AS turn, size, pack FROM walk")
def _(t):
    return C.packed(t.conversations.selectExpr("conv_id", "turn", "coalesce(length(text), 0) + 4 size"), "conv_id", ["turn"], "size", 4, 1200)


@query("W8_char_budget", packs_sql("SELECT user_id AS g, event_id AS o, 1 + CAST(floor(value) AS BIGINT) AS size FROM events", C.BLOCK, 250) + " SELECT g AS user_id, o AS event_id, size, pack FROM walk")
def _(t):
    return C.packed(t.events.selectExpr("user_id", "event_id", "1 + cast(floor(value) as bigint) size"), "user_id", ["event_id"], "size", C.BLOCK, 250)


@query("C22_comments")
def _(t):
    code = "concat('const a = 1; // how ', p_name, ' came to be used here\\n/* first line of a note\\n * on ', p_brand, ' and its size */\\nlet s = ', p_size, ';') text"
    return per_text(t.part.selectExpr("p_partkey", code), "p_partkey", "text", "first_line int, last_line int, prose string", comments)


@query("C23_dependencies")
def _(t):
    text = t.part.selectExpr("p_partkey", "concat(replace(p_name, ' ', '-'), '==', p_size, '.0') text")
    return per_text(text, "p_partkey", "text", "ecosystem string, package string, version string", lambda x: dependencies("requirements.txt", x))


@query("C32_manifests")
def _(t):
    text = "concat('apiVersion: v1\nkind: ', CASE s_suppkey % 3 WHEN 0 THEN 'Role' WHEN 1 THEN 'Deployment' ELSE 'ConfigMap' END, '\nspec:\n  containers:\n    - name: a\n      image: hub/app', s_suppkey, ':1\n---\napiVersion: v1\nkind: Service\n') text"
    return per_text(t.supplier.selectExpr("s_suppkey", text), "s_suppkey", "text", "ecosystem string, name string", manifest_facts)


@query("C35_workflow_concepts")
def _(t):
    rows = t.supplier.selectExpr("s_suppkey", "concat('jobs:\n  build:\n    steps:\n      - run: ', CASE WHEN s_suppkey % 2 = 0 THEN 'kubectl apply -f x' ELSE 'make test' END) text")
    return per_text(rows, "s_suppkey", "text", "concept string, detector string, confidence double", lambda x: workflow_concepts(".github/workflows/ci.yml", x))
