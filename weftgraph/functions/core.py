"""Column functions of the graph engine. All stay in the JVM, except ``resolve_url`` (an Arrow function)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import NEGATIONS, STAGE_WEIGHTS, STOP_WORDS, TRUST_PRIORITY


def _map(values: dict, key: Column, default) -> Column:
    """A lookup in a small fixed table."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; 0 when a norm is 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character sets of two strings."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 when one holds the other, else the character Jaccard; case is ignored."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, F.lit(1.0)).when(x.contains(y) | y.contains(x), F.lit(0.8)).otherwise(char_jaccard(x, y))


def round_binary(x: Column, places: int) -> Column:
    """A double rounded as SQL engines without decimals do: the product with a power of ten to the nearest whole number, divided again."""
    return F.round(x * 10.0**places, 0) / 10.0**places


def entity_credit(score: Column) -> Column:
    """Credit of an entity's nearest neighbour: full from 0.85, linear from 0.55, 0.4 without a neighbour."""
    return F.when(score.isNull(), 0.4).when(score >= 0.85, 1.0).otherwise(round_binary(F.greatest(F.lit(0.0), (score - 0.55) / 0.30), 3))


def rel_credit(similarity: Column, same_type: Column) -> Column:
    """Credit of a stored edge as evidence: 0.95 for the same type, else from 0.75 upward for a similarity of 0.6."""
    return F.when(same_type, 0.95).when(similarity >= 0.6, 0.75 + (similarity - 0.6) * 0.5)


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Mean of the scores that are present, by weight; null when none is."""
    up = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in pairs), F.lit(0.0))
    down = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in pairs), F.lit(0.0))
    return F.when(down > 0, up / down)


def confidence_level(c: Column) -> Column:
    return F.when(c < 0.4, "low").when(c < 0.7, "medium").when(c < 0.9, "high").otherwise("very_high")


def trust_priority(trust: Column) -> Column:
    return _map(TRUST_PRIORITY, trust, 0)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def progress_pct(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(0.0)


def job_progress(finished: Column, current: Column, fraction: Column) -> Column:
    """Weights of the finished stages before the current one plus its own, as far as it has come."""
    total = F.lit(0.0)
    for k, (stage, w) in enumerate(STAGE_WEIGHTS.items()):
        reached = F.array_position(F.array(*map(F.lit, STAGE_WEIGHTS)), current)
        total = total + F.when((F.lit(k + 1) < reached) & F.array_contains(finished, stage), w).when(current == stage, clamp01(fraction) * w).otherwise(0.0)
    return total


def clean_text(c: Column) -> Column:
    """Every run of white space becomes a space, control characters go, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))


def strip_bad_chars(c: Column) -> Column:
    """Quotes go, line feeds become spaces."""
    return F.translate(F.regexp_replace(c, "\n", " "), "\"'", "")


def search_terms(text: Column) -> Column:
    """Words of three characters or more that are no stop words, each once (case ignored), in order."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_-]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*STOP_WORDS))
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(F.lower(w).alias("k"), i.alias("i"), w.alias("w"))))
    # the sorted array is bound once, so that each word looks at its neighbour alone
    first = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"])))
    return F.transform(F.array_sort(F.transform(F.get(first, 0), lambda x: F.struct(x["i"], x["w"].alias("w")))), lambda x: x["w"])


def title_case(s: Column) -> Column:
    """Each run of letters with a capital first and small letters after, as Python's title()."""
    parts = F.regexp_extract_all(s, F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def capitalised(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def relation_name(s: Column) -> Column:
    return F.upper(F.replace(s, F.lit(" "), F.lit("_")))


def camel_key(s: Column) -> Column:
    """Property key in camel case; a blank key stays as it is."""
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(capitalised(w))), "")
    return F.when(F.size(words) == 0, s).otherwise(joined)


def snippet(s: Column, most: int = 220) -> Column:
    """Trimmed text, cut at the last space when longer than ``most``; null for null or empty."""
    t = F.trim(s)
    head = F.substring(t, 1, most - 1)
    return (
        F.when(s.isNull() | (s == ""), None)
        .when(F.length(t) <= most, t)
        .otherwise(F.concat(F.regexp_replace(head, r"(?s)^(.*) [^ ]*$", "$1"), F.lit("…")))
    )


def entity_text(name: Column, description: Column) -> Column:
    return F.concat_ws(" — ", name, F.when(description != "", description))


def rel_text(source: Column, kind: Column, target: Column, description: Column) -> Column:
    return F.concat_ws(" ", source, kind, target, F.when(description != "", description))


def has_negation(s: Column) -> Column:
    """A negation opens the text or follows a space in it."""
    words = "|".join(re.escape(w) for w in NEGATIONS)
    return F.lower(F.trim(F.coalesce(s, F.lit("")))).rlike(f"(?:^| )(?:{words})")


def term_present(text: Column, term: Column, whole_word: bool = False, case_sensitive: bool = False) -> Column:
    """The term stands in the text, as a substring or as a whole word."""
    x, y = (text, term) if case_sensitive else (F.lower(text), F.lower(term))
    return F.regexp_like(x, F.concat(F.lit(r"\b\Q"), y, F.lit(r"\E\b"))) if whole_word else x.contains(y)


def content_id(*cols: Column) -> Column:
    """A stable id from the natural key's parts."""
    return F.sha1(F.concat_ws(":", *[c.cast("string") for c in cols]))


def unfence(s: Column) -> Column:
    """A reply without the code fence around its JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def parse_reply(s: Column, schema: str) -> Column:
    """The reply's JSON by schema; null when it is none."""
    return F.from_json(unfence(s), schema, {"mode": "PERMISSIVE"})


def parse_ts(s: Column, default: str = "1970-01-01T00:00:00") -> Column:
    """ISO time with Z or an offset; the default when it can't be read."""
    return F.coalesce(F.try_to_timestamp(s), F.lit(default).cast("timestamp"))


def annotate(annotations: Column, **values: Column) -> Column:
    """Annotations with values set; earlier values of the keys go."""
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    kept = F.map_filter(F.coalesce(annotations, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*values))
    return F.map_concat(kept, new)


@F.pandas_udf(StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """An absolute link from a page's url and an href."""
    from urllib.parse import urljoin

    return pd.Series([urljoin(b, h) if b is not None and h is not None else None for b, h in zip(base, href, strict=True)], dtype=object)


def valid_types(column: str, kinds: tuple[str, ...]) -> Column:
    """The value is exactly one of the model's."""
    return F.coalesce(F.col(column).isin(*kinds), F.lit(False))
