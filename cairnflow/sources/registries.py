"""Entries of package registries: what each registry's documents hold, as one table; which entries are kept, and of what category they are."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ENTRY = tuple[str, str | None, str | None, str | None, str | None, list[str] | None, str | None, list[str] | None]


def _texts(found) -> list[str] | None:
    return [str(x) for x in found if x] if isinstance(found, list) else None


def repository(url) -> str | None:
    """A repository's web address, without the marks of its transport."""
    return url.removeprefix("git+").removesuffix(".git") if isinstance(url, str) else None


def npm(d: dict) -> Iterator[ENTRY]:
    if isinstance(d.get("name"), str):
        where = d.get("repository")
        yield "npm", d["name"], d["name"], d["name"], d.get("description"), _texts(d.get("keywords")), repository(where.get("url") if isinstance(where, dict) else where), None


def pypi(d: dict) -> Iterator[ENTRY]:
    info = d.get("info") if isinstance(d.get("info"), dict) else {}
    if info.get("name"):
        said, links = info.get("keywords"), info.get("project_urls") or {}
        words = said.replace(",", " ").split() if isinstance(said, str) else None
        low = info["name"].lower()
        yield "pypi", low, low, info["name"], info.get("summary"), words or None, links.get("Source") or links.get("Homepage"), _texts(info.get("classifiers"))


def maven(d: dict) -> Iterator[ENTRY]:
    for x in (d.get("response") or {}).get("docs") or []:
        whole = f"{x['g']}:{x['a']}"
        yield "maven", whole, x["a"].lower(), x["a"], None, [x["a"], x["g"], whole], None, None


def crates(d: dict) -> Iterator[ENTRY]:
    for x in d.get("crates") or []:
        yield "cargo", x["id"], x["id"], x.get("name") or x["id"], x.get("description"), _texts(x.get("keywords")), repository(x.get("repository")), _texts(x.get("categories"))


def services(d: dict) -> Iterator[ENTRY]:
    """A cloud's list of services: {provider, services: [{id, name, aliases}]}."""
    for x in d.get("services") or []:
        name = str(x.get("id", "")).lower().replace("-", "_")
        yield d.get("provider"), x.get("id"), f"{d.get('provider')}_{name}", x.get("name"), None, _texts(x.get("aliases")), None, None


def curated(d: dict) -> Iterator[ENTRY]:
    """A curated list: {ecosystem, entries: [{name, category, aliases}]}."""
    for x in d.get("entries") or []:
        yield d.get("ecosystem"), x.get("name"), str(x.get("name", "")).lower(), x.get("name"), x.get("description"), _texts(x.get("aliases")), None, [x["category"]] if x.get("category") else None


FORMATS = {"npm": npm, "pypi": pypi, "maven": maven, "crates": crates, "services": services, "curated": curated}

#: Identifiers of npm packages that are dropped.
NPM_DROPPED = ("^@types/", "(?i)polyfill", "^is-[a-z]+$", "^eslint-(config|plugin)-", "^babel-(plugin|preset)-")


def kept(entries: DataFrame, dropped: tuple[str, ...] = NPM_DROPPED) -> DataFrame:
    """Entries none of whose ``dropped`` patterns their identifier matches, each (ecosystem, identifier) once, the one of the most keywords."""
    some = entries.where(F.col("identifier").isNotNull() & ~F.col("identifier").rlike("|".join(f"(?:{p})" for p in dropped) or "^$"))
    order = W.partitionBy("ecosystem", "identifier").orderBy(F.desc(F.coalesce(F.size("keywords"), F.lit(0))), "display", "description")
    return some.withColumn("rn_", F.row_number().over(order)).where("rn_ = 1").drop("rn_")


def categorised(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Entries with ``category``: that of their first class (in its list's order) that begins with a known prefix (place, prefix, category; a small table, the
    first by place), else null."""
    each = entries.select("ecosystem", "identifier", F.posexplode("classes").alias("at", "class_"))
    hit = each.join(F.broadcast(prefixes), F.startswith("class_", "prefix")).groupBy("ecosystem", "identifier").agg(F.min_by("category", F.struct("at", "place")).alias("category"))
    return entries.join(hit, ["ecosystem", "identifier"], "left")


def names(canonical: Column, aliases: Column) -> tuple[Column, Column]:
    """S6, rows derived from known technologies: the name with blanks for underscores, and its aliases: the name as it was, if it differs, and the others,
    trimmed and in lower case, each once."""
    raw = F.lower(F.trim(canonical))
    spoken = F.replace(raw, F.lit("_"), F.lit(" "))
    others = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.lower(F.trim(a))), lambda a: F.length(a) > 0)
    return spoken, F.array_distinct(F.concat(F.filter(F.array(raw), lambda a: a != spoken), others))
