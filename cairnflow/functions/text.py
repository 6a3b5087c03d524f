"""Text functions as column expressions: tokens, normal forms, classifiers, scrubbers. All run inside Spark's generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

TOKEN = "[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 0)


def term(text: Column, dropped: tuple[str, ...] = ("advanced", "basic", "experience", "knowledge")) -> Column:
    """M1: a term in normal form: lower case, other characters as spaces, qualifiers dropped."""
    keep = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) > 0) & ~w.isin(*dropped))
    return F.array_join(keep, " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def escaped(text: Column) -> Column:
    """H7: the five characters of XML that need it."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def without_wikilinks(text: Column) -> Column:
    """``[[page|alias]]`` becomes its alias, ``[[folder/page]]`` its last part."""
    text = F.regexp_replace(text, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1")
    return F.regexp_replace(text, r"\[\[(?:[^\]/]*/)*([^\]/]*)\]\]", "$1")


def path_tags(path: Column) -> Column:
    """The directories of a path, without those that are ``.`` or start with ``_``."""
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: (p != ".") & (p != "") & ~F.startswith(p, F.lit("_")))


def iso_week(ts: Column) -> Column:
    """``YYYY-Www``."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


#: Rules of the file classifier, the first that matches a lower-case path counts.
FILE_CLASSES = (
    ("generated", r"(?:^|/)(?:dist|build|vendor|node_modules)/|\.min\.js$"),
    ("lockfile", r"(?:^|/)(?:package-lock\.json|yarn\.lock|poetry\.lock|cargo\.lock|go\.sum)$"),
    ("test", r"(?:^|/)(?:tests?|__tests__|spec)/|[._-](?:test|spec)\.[a-z]+$|(?:^|/)test_[^/]*\.py$"),
    ("ci", r"(?:^|/)\.github/workflows/|(?:^|/)\.gitlab-ci\.yml$|(?:^|/)jenkinsfile$"),
    ("infra", r"\.tf$|(?:^|/)dockerfile$|(?:^|/)(?:k8s|helm|charts|terraform)/"),
    ("doc", r"\.(?:md|mdx|rst|adoc|txt)$"),
    ("config", r"\.(?:json|ya?ml|toml|ini|env)$"),
    ("sql", r"\.sql$"),
    ("style", r"\.(?:css|scss|less)$"),
    ("source", r"\.(?:ts|tsx|js|jsx|py|go|rs|java|kt|rb|c|cc|cpp|h|cs|php|swift|scala)$"),
)

#: Rules of the document classifier over file name, path and the first 2,000 characters.
DOC_TYPES = (
    ("readme", "path", r"(?:^|/)readme[^/]*$"),
    ("changelog", "path", r"(?:^|/)(?:changelog|history|releases?)[^/]*$"),
    ("license", "path", r"(?:^|/)(?:licen[cs]e|copying)[^/]*$"),
    ("contributing", "path", r"(?:^|/)contributing[^/]*$"),
    ("decision", "path", r"(?:^|/)(?:adr|decisions?)/"),
    ("runbook", "path", r"(?:^|/)(?:runbooks?|playbooks?)/"),
    ("api", "path", r"(?:^|/)(?:api|reference)/"),
    ("tutorial", "head", r"(?:step 1|getting started|in this tutorial)"),
    ("postmortem", "head", r"(?:postmortem|root cause|incident)"),
)


def file_class(path: Column) -> Column:
    low = F.lower(path)
    out = None
    for name, rule in FILE_CLASSES:
        out = F.when(low.rlike(rule), name) if out is None else out.when(low.rlike(rule), name)
    return out.otherwise("other")


def doc_type(path: Column, text: Column) -> Column:
    look = {"path": F.lower(path), "head": F.lower(F.substring(text, 1, 2000))}
    out = None
    for name, where, rule in DOC_TYPES:
        hit = look[where].rlike(rule)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


#: H1: kinds of personal data and their patterns, none of which looks around.
PII = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("CARD", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}\b"),
    ("IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("PHONE", r"\+[0-9]{1,3}[ (.-]+[0-9]{2,4}[ ).-]+[0-9]{3}[ .-]?[0-9]{4}"),
)


def pii_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(rule)).cast("long").alias(f"n_{name.lower()}") for name, rule in PII]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: H2: what a text must hold for a kind's pattern to be worth a scan.
SCRUB_SIGNS = {"EMAIL": "@", "PHONE": "+"}


def scrubbed(text: Column) -> Column:
    """H2 by ordered replacement: an earlier kind hides its digits from later ones. A kind whose sign is missing is not searched."""
    def step(rule: str, by: str, sign: str | None):
        replaced = lambda x: F.regexp_replace(x, rule, by)
        return (lambda x: F.when(F.contains(x, F.lit(sign)), replaced(x)).otherwise(x)) if sign else replaced

    for name, rule in PII:
        use = step(rule, f"[{name}]", SCRUB_SIGNS.get(name))
        text = bound(text, use) if name in SCRUB_SIGNS else use(text)
    return text


def without_nul(text: Column) -> Column:
    """The text without NUL characters."""
    return F.regexp_replace(text, "\\x00", "")


#: Signs that are written out as words, unless a caller has others.
SIGNS = {"≥": "at least", "≤": "at most", "→": "to"}


def normal_prose(text: Column, signs: dict[str, str] | None = None, above: str = "more than") -> Column:
    """Prose word by word: a sign stands for its words, a long dash for a comma, a number with one plus at its end is ``above`` it; a comma
    joins the word before it, at most one and none before another stop. Words are parted by one blank; line ends stay."""
    signs = SIGNS if signs is None else signs
    apart = F.regexp_replace(F.replace(text, F.lit("—"), F.lit(",")), "([," + "".join(re.escape(s) for s in signs) + "])", " $1 ")
    names = F.create_map(*[F.lit(x) for kv in signs.items() for x in kv]) if signs else F.lit(None).cast("map<string,string>")
    number = r"^([^0-9+]*)([0-9][0-9.,]*)[+]([^0-9+]*)$"
    said = F.transform(F.split(apart, "[ \t]+"), lambda w: F.coalesce(F.try_element_at(names, w), F.regexp_replace(w, number, f"$1{above} $2$3")))

    def join(held: Column, w: Column) -> Column:
        bare = F.rtrim(held, F.lit(","))
        return F.when(w == "", held).when(w == ",", F.when(held == "", held).otherwise(F.concat(bare, w))).when(w.rlike("^[.;:!?]"), F.concat(bare, w)).when(held == "", w).otherwise(F.concat(held, F.lit(" "), w))

    return F.aggregate(said, F.lit(""), join)


#: H3: labels and patterns of injected instructions, the first that matches blocks.
INJECTIONS = (
    ("override", r"(?i)\b(?:ignore|disregard|forget) (?:all |any |the )?(?:previous|prior|above) (?:instructions|rules)\b"),
    ("role", r"(?i)\byou are now\b|\bact as (?:a|an)\b"),
    ("reveal", r"(?i)\b(?:reveal|print|show) (?:your |the )?(?:system )?prompt\b"),
    ("secret", r"(?i)\b(?:password|token|secret|api key)\s*[=:]"),
)


def injection(text: Column) -> Column:
    squeezed = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.coalesce(*[F.when(squeezed.rlike(rule), label) for label, rule in INJECTIONS])


#: H6: what an answer must not give away, replaced in this order.
OUTPUT = (
    (r"arn:aws:[a-z0-9-]*:[a-z0-9-]*:[0-9]*:[A-Za-z0-9/_.:-]+", "[ARN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[KEY]"),
    (r"https?://[a-z0-9.-]*(?:internal|local)[a-z0-9./-]*", "[INTERNAL]"),
    (r"\b(?:10|192\.168|172\.16)(?:\.[0-9]{1,3}){2,3}\b", "[IP]"),
    (r"(?i)\b(token|secret|password)\s*=\s*\"?[A-Za-z0-9+/_-]{8,}\"?", "$1=[SECRET]"),
    (r"\b[0-9]{12}\b", "[ACCOUNT]"),
)


def redacted(text: Column) -> Column:
    for rule, by in OUTPUT:
        text = F.regexp_replace(text, rule, by)
    return text


def prose_only(text: Column) -> Column:
    """Markdown without front matter, fenced code, component tags and inline code."""
    for rule in (r"(?s)^---\n.*?\n---\n", r"(?s)```.*?```", r"<[A-Z][A-Za-z]*[^>]*/?>", r"`[^`\n]*`"):
        text = F.regexp_replace(text, rule, " ")
    return text


def html_text(html: Column) -> Column:
    """N2, tag variant: scripts, styles and tags go, common entities and white space are made plain."""
    for rule, by in ((r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?s)<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), (r"\s+", " ")):
        html = F.regexp_replace(html, rule, by)
    return F.trim(html)


def reading_ease(text: Column, least: int = 25) -> Column:
    """Flesch reading ease with vowel groups as syllables, less one for a word's last e, one at least; null under ``least`` words.

    Counted on the whole text: vowel groups, less words that end in e, and one each for words without a vowel group but that of a last e."""
    low = F.lower(text)
    count = lambda rule: F.regexp_count(low, F.lit(rule))
    n = count("[a-z]+")
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    other = "[b-df-hj-np-tv-xz]"
    total = count("[aeiouy]+") - count("e(?![a-z])") + count(f"(?<![a-z]){other}++(?![a-z])") + count(f"(?<![a-z]){other}*+[aeiouy]*e(?![a-z])")
    return F.when(n >= least, F.round(F.lit(206.835) - F.lit(1.015) * (n / sentences) - F.lit(84.6) * (total / n), 4))


def stem(word: Column) -> Column:
    """A light stem: ``-ly`` and ``-ing`` where four letters stay."""
    return F.regexp_replace(word, "^([a-z]{4,})(?:ly|ing)$", "$1")
