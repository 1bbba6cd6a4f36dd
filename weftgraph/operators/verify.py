"""Verification: text match, cascade and roll-up, status rules, conflicts and reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import clamp01, content_id, entity_credit, has_negation, parse_reply, round_binary, term_present, trust_priority, weighted_mean
from ..staging import stage as written
from .joins import join_by_id

STAGE_WEIGHTS = {"text_match": 0.20, "embedding": 0.35, "llm": 0.45}
VERDICT_SCHEMA = "verdict string, confidence double, reasoning string"


def verify_text(rows: DataFrame, least_ratio: float = 0.5, whole_word: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Text match of (source_name, target_name, extra_terms, relationship_type, context).

    Names and extra terms are required, the type's words are not. text_confidence is the share of all terms found (4
    places), text_status passed when at least ``least_ratio`` of the required ones are; an empty context fails with 0.
    """
    required = F.filter(
        F.concat(F.array("source_name", "target_name"), F.coalesce("extra_terms", F.array().cast("array<string>"))),
        lambda t: F.coalesce(t, F.lit("")) != "",
    )
    soft = F.filter(F.array(F.replace("relationship_type", F.lit("_"), F.lit(" "))), lambda t: F.coalesce(t, F.lit("")) != "")
    text = F.coalesce("context", F.lit(""))
    rows = rows.withColumn("required", required).withColumn("terms", F.concat("required", soft))

    def found(c: str) -> Column:
        return F.filter(c, lambda t: term_present(text, t, whole_word, case_sensitive))

    rows = rows.withColumn("matched", found("terms")).withColumn("unmatched", F.array_except("terms", "matched"))
    ratio = F.when(F.size("required") > 0, F.size(found("required")) / F.size("required")).otherwise(1.0)
    blank = F.trim(text) == ""
    share = F.when(F.size("terms") > 0, F.size("matched") / F.size("terms")).otherwise(1.0)
    return (
        rows.withColumn("text_confidence", F.when(blank, 0.0).otherwise(F.round(share, 4)))
        .withColumn("text_status", F.when(~blank & (ratio >= least_ratio), "passed").otherwise("failed"))
        .drop("required", "terms")
    )


def parse_verdict(rows: DataFrame, uncertain: str = "failed") -> DataFrame:
    """Model verdicts from ``reply``: llm_status and llm_confidence; no JSON or an empty context fails with 0."""
    r = parse_reply(F.col("reply"), VERDICT_SCHEMA)
    ok = r["verdict"].isNotNull() & (F.trim(F.coalesce("context", F.lit(""))) != "")
    status = F.when(r["verdict"] == "valid", "passed").when(r["verdict"] == "uncertain", uncertain).otherwise("failed")
    return rows.withColumn("llm_status", F.when(F.col("reply").isNull(), None).when(ok, status).otherwise("failed")).withColumn(
        "llm_confidence", F.when(F.col("reply").isNull(), None).when(ok, clamp01(F.coalesce(r["confidence"], F.lit(0.0)))).otherwise(0.0)
    )


def verify_cascade(rows: DataFrame, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Stop at the first stage that decides, and roll the stages that ran up to one confidence and status.

    Takes the status and confidence columns of text_match (text_), embedding (embedding_) and llm (llm_); a null status
    means the stage is absent, ``skipped`` that it says nothing. Costly stages should be computed only for rows that
    ``undecided`` still returns.
    """

    def decides(p: str) -> Column:
        c = F.col(f"{p}_confidence")
        return F.coalesce(F.col(f"{p}_status").isin("passed", "failed") & ((c >= high) | (c < low)), F.lit(False))

    ran_embedding = ~decides("text") & F.col("embedding_status").isNotNull()
    ran_llm = ~decides("text") & ~(ran_embedding & decides("embedding")) & F.col("llm_status").isNotNull()
    decisive = (
        F.when(decides("text"), "text_match")
        .when(ran_embedding & decides("embedding"), "embedding")
        .when(ran_llm & (F.col("llm_status") != "skipped"), "llm")
    )

    def score(p: str, ran: Column) -> Column:
        return F.when(ran & (F.col(f"{p}_status") != "skipped"), F.col(f"{p}_confidence"))

    stages = [
        (score("text", F.col("text_status").isNotNull()), STAGE_WEIGHTS["text_match"]),
        (score("embedding", ran_embedding), STAGE_WEIGHTS["embedding"]), (score("llm", ran_llm), STAGE_WEIGHTS["llm"]),
    ]
    rows = rows.withColumn("decisive_stage", decisive).withColumn("confidence", F.round(F.coalesce(weighted_mean(stages), F.lit(0.0)), 4))
    any_ran = F.coalesce("text_status", F.when(ran_embedding, F.col("embedding_status")), F.when(ran_llm, F.col("llm_status"))).isNotNull()
    none_said = sum((F.when(s.isNotNull(), 1).otherwise(0) for s, _ in stages), F.lit(0)) == 0
    own = (
        F.when(F.col("decisive_stage") == "text_match", F.col("text_status"))
        .when(F.col("decisive_stage") == "embedding", F.col("embedding_status"))
        .when(F.col("decisive_stage") == "llm", F.col("llm_status"))
    )
    status = (
        F.when(~any_ran, "failed")
        .when(none_said, "skipped")
        .otherwise(F.coalesce(own, F.when(F.col("confidence") >= 0.5, "passed").otherwise("failed")))
    )
    return rows.withColumn("status", status)


def undecided(rows: DataFrame, stage: str, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Rows that a stage has not decided; later stages run on these alone."""
    c = F.col(f"{stage}_confidence")
    return rows.where(~F.coalesce(F.col(f"{stage}_status").isin("passed", "failed") & ((c >= high) | (c < low)), F.lit(False)))


Stage = Callable[[DataFrame], DataFrame]


def run_cascade(rows: DataFrame, stages: dict[str, Stage], id_col: str = "relationship_id", high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Run verification stages one after the other, each on the rows that the ones before have left undecided.

    ``stages`` has functions for ``text``, ``embedding`` and ``llm``, or some of them: each takes the rows that are still open,
    with all columns of ``rows``, and gives ``id_col``, <stage>_status and <stage>_confidence for them (more columns are not kept; a row that
    it leaves out has not run). What a stage says is written before the next one starts, so a stage is paid for once, and only for open rows.
    Returns ``rows`` with the stages' columns, decisive_stage, confidence, status (``verify_cascade``) and reasoning. ``id_col`` is distinct and
    not null; an empty table runs every stage on no rows. Another stage's name raises ValueError.
    """
    names = ("text", "embedding", "llm")
    if unknown := sorted(set(stages) - set(names)):
        raise ValueError(f"stages {unknown}")
    rows = rows.drop(*(f"{p}_{c}" for p in names for c in ("status", "confidence")))
    still, out = rows, rows
    for p in names:
        status, confidence = f"{p}_status", f"{p}_confidence"
        if p not in stages:
            out = out.withColumns({status: F.lit(None).cast("string"), confidence: F.lit(None).cast("double")})
            continue
        said = written(stages[p](still).select(id_col, status, F.col(confidence).cast("double").alias(confidence)), f"stage-{p}")
        decided = said.select(id_col).exceptAll(undecided(said, p, high, low).select(id_col))
        still = still.join(decided, id_col, "left_anti")
        out = out.join(said, id_col, "left")
    return verify_cascade(out, high, low).withColumn("reasoning", cascade_reasoning())


def cascade_reasoning(threshold: float = 0.5) -> Column:
    """What a cascade decided, where, and what each stage that ran has said, as text."""
    names = {"text": "text_match", "embedding": "embedding", "llm": "llm"}
    status, c = ({p: F.col(f"{p}_{x}") for p in names} for x in ("status", "confidence"))
    said = F.when(F.col("decisive_stage") == "text_match", c["text"]).when(F.col("decisive_stage") == "embedding", c["embedding"]).otherwise(c["llm"])
    # The wording of the text.
    how = F.when(
        F.col("decisive_stage").isNotNull(), F.format_string("decided at %s stage (confidence %.2f)", "decisive_stage", said),
    ).otherwise(f"no decisive stage; weighted confidence vs threshold {threshold}")
    mark = {p: F.when(status[p] == "passed", "PASS").when(status[p] == "skipped", "SKIP").otherwise("FAIL") for p in names}
    each = F.concat_ws("; ", *[F.when(status[p].isNotNull(), F.format_string(f"{n}: %s (%.2f)", mark[p], c[p])) for p, n in names.items()])
    verdict = F.when(F.col("status") == "passed", "PASSED").otherwise("FAILED")
    return (
        F.when(F.coalesce(*status.values()).isNull(), "No stages were run.")
        .when(F.col("status") == "skipped", "All stages were skipped.")
        .otherwise(F.concat(verdict, F.lit(" — "), how, F.lit(". Weighted confidence "), F.format_string("%.4f", "confidence"), F.lit(". "), each))
    )


def classify_relationships(rows: DataFrame, conflict_status: str = "rejected") -> DataFrame:
    """verification_status from confidence, source_trust and conflict: the rules in their order."""
    c = F.col("confidence")
    return rows.withColumn(
        "verification_status",
        F.when(F.coalesce("conflict", F.lit(False)), conflict_status).when(c >= 0.90, "verified").when((F.col("source_trust") == "reviewed") & (c >= 0.60), "verified").when(c < 0.60, "flagged").otherwise("unverified"),
    )


def classify_entities(rows: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return rows.withColumn(
        "verification_status",
        (
            F.when(c >= 0.85, "verified")
            .when((F.col("source_trust") == "reviewed") & (c >= 0.60), "verified")
            .when(c < 0.50, "flagged")
            .otherwise("unverified")
        ),
    )


def verify_entities(rows: DataFrame) -> DataFrame:
    """Entity check of (name, aliases, context, neighbour_score, has_vectors): text 1 / 0.7 / 0 blended .45 / .55 with the vector credit."""
    text = (
        F.when(term_present(F.col("context"), F.col("name")), 1.0)
        .when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: term_present(F.col("context"), a)), 0.7)
        .otherwise(0.0)
    )
    text = F.when(F.trim(F.coalesce("context", F.lit(""))) != "", text)
    vector = F.when(F.col("has_vectors"), entity_credit(F.col("neighbour_score")))
    rows = rows.withColumn("confidence", round_binary(weighted_mean([(text, 0.45), (vector, 0.55)]), 4))
    return rows.withColumn(
        "status",
        (
            F.when(F.col("confidence") >= 0.6, "passed")
            .when(F.col("confidence").isNull() | (F.col("confidence") >= 0.3), "inconclusive")
            .otherwise("failed")
        ),
    )


def _pair() -> list[Column]:
    """The ends of an edge as (pair, p, q), whichever way it goes; pair is a hash of both, so that sorting compares numbers before texts."""
    p, q = F.least("source_entity_id", "target_entity_id"), F.greatest("source_entity_id", "target_entity_id")
    return [F.xxhash64(p, q).alias("pair"), p.alias("p"), q.alias("q")]


def _said() -> Column:
    """What the rules see of a description: empty, plain or negated."""
    text = F.lower(F.trim(F.coalesce("description", F.lit(""))))
    return F.when(text == "", "empty").when(has_negation(text), "negated").otherwise("plain")


def detect_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Conflicts of new edges with stored ones on the same pair, in either direction.

    Another type is inconsistent (medium); the same type with exactly one negated description is contradictory (high).
    A review is needed when the stored edge is the more trusted. Descriptions are judged before edges meet and stay behind.
    """
    return _conflicts(new, stored, [], []).select(*CONFLICT)


CONFLICT = ("new_relationship_id", "old_relationship_id", "conflict_type", "severity", "requires_review")


def _conflicts(new: DataFrame, stored: DataFrame, new_more: list[Column], old_more: list[Column]) -> DataFrame:
    """The conflicts with ends (p, q), types, and what else of the new and the stored edge is asked for."""
    a, b = (
        edges.select(*_pair(), F.col("relationship_id").alias(f"{k}_relationship_id"), F.col("relationship_type").alias(f"{k}_type"), _said().alias(f"{k}_said"), trust_priority(F.col("trust")).alias(f"{k}_trust"), *more)
        for edges, k, more in ((new, "new", new_more), (stored, "old", old_more))
    )
    other = F.col("new_type") != F.col("old_type")
    negated = ~other & (F.col("new_said") != F.col("old_said")) & (F.col("new_said") != "empty") & (F.col("old_said") != "empty")
    met = a.join(b, ["pair", "p", "q"]).where("new_relationship_id <> old_relationship_id")
    met = met.withColumn("conflict_type", F.when(other, "inconsistent").when(negated, "contradictory")).where(F.col("conflict_type").isNotNull())
    return met.withColumns({"severity": F.when(F.col("conflict_type") == "contradictory", "high").otherwise("medium"), "requires_review": F.col("old_trust") > F.col("new_trust")})


def conflict_classes(new: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conflicts of ``detect_conflicts`` by classes: n + m rows where a pair of ends has n new and m stored edges.

    Edges of a pair of ends (p, q) that the rules can't tell apart are one class: type, whether the description is empty, plain or negated, and trust.
    Returns conflicts between classes (pair, p, q, new_class, old_class, conflict_type, severity, requires_review, n_new, n_old, n_pairs, and the
    smallest id of either as new_example, old_example), and membership (side, relationship_id, pair, p, q, class). ``n_pairs`` leaves out an edge and itself,
    where both tables have it. ``expand_conflicts`` gives the single pairs.
    """
    keys = ["pair", "p", "q"]

    def classed(edges: DataFrame, side: str) -> DataFrame:
        return edges.select(
            F.lit(side).alias("side"), "relationship_id", *_pair(),
            F.struct(F.col("relationship_type").alias("type"), _said().alias("kind"), trust_priority(F.col("trust")).alias("trust")).alias("class"),
        ).where("p is not null and q is not null and class.type is not null")

    def counted(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(*keys, F.col("class").alias(f"{side}_class")).agg(F.count("*").alias(f"n_{side}"), F.min("relationship_id").alias(f"{side}_example"))

    a, b = classed(new, "new"), classed(stored, "old")
    met = counted(a, "new").join(counted(b, "old"), keys)
    other = F.col("new_class.type") != F.col("old_class.type")
    kinds = F.array_sort(F.array("new_class.kind", "old_class.kind"))
    found = met.withColumn("conflict_type", F.when(other, "inconsistent").when(kinds == F.array(F.lit("negated"), F.lit("plain")), "contradictory"))
    both = a.join(b.select("relationship_id", *keys, F.col("class").alias("old_class")), [*keys, "relationship_id"])
    own = both.groupBy(*keys, F.col("class").alias("new_class"), "old_class").agg(F.count("*").alias("n_own"))
    found = found.where("conflict_type is not null").join(own, [*keys, "new_class", "old_class"], "left")
    found = found.select(
        *keys, "new_class", "old_class", "conflict_type", F.when(F.col("conflict_type") == "contradictory", "high").otherwise("medium").alias("severity"),
        (F.col("old_class.trust") > F.col("new_class.trust")).alias("requires_review"), "n_new", "n_old",
        (F.col("n_new") * F.col("n_old") - F.coalesce("n_own", F.lit(0))).alias("n_pairs"), "new_example", "old_example",
    )
    return found.where("n_pairs > 0"), a.unionByName(b)


def expand_conflicts(classes: DataFrame, membership: DataFrame) -> DataFrame:
    """The single conflicts of ``detect_conflicts``: every new member of a class with every old one of the other."""
    new, old = (
        membership.where(F.col("side") == side).select("pair", "p", "q", F.col("class").alias(f"{side}_class"), F.col("relationship_id").alias(f"{side}_relationship_id"))
        for side in ("new", "old")
    )
    rows = classes.join(new, ["pair", "p", "q", "new_class"]).join(old, ["pair", "p", "q", "old_class"])
    return rows.where("new_relationship_id <> old_relationship_id").select(
        "new_relationship_id", "old_relationship_id", "conflict_type", "severity", "requires_review",
    )


def conflict_reasoning(conflicts: DataFrame, new: DataFrame, stored: DataFrame, entities: DataFrame) -> DataFrame:
    """Conflicts (new_relationship_id, old_relationship_id, conflict_type, requires_review, …) with ``reasoning``, the text that a reviewer reads."""
    fields = {"relationship_type": "type", "description": "text", "trust": "trust"}
    a = new.select(F.col("relationship_id").alias("new_relationship_id"), "source_entity_id", "target_entity_id", *(F.col(c).alias(f"new_{n}") for c, n in fields.items()))
    b = stored.select(F.col("relationship_id").alias("old_relationship_id"), *(F.col(c).alias(f"old_{n}") for c, n in fields.items()))
    rows = join_by_id(join_by_id(conflicts, a, "new_relationship_id"), b, "old_relationship_id")
    return _named(rows, entities).withColumn("reasoning", _reasoning()).select(*conflicts.columns, "reasoning")


def reasoned_conflicts(new: DataFrame, stored: DataFrame, entities: DataFrame) -> DataFrame:
    """What ``conflict_reasoning`` gives for ``detect_conflicts``: an edge brings its texts where it meets the other, and is not looked for again.

    Only another type is told with the names of the ends, so contradictions are not joined with entities.
    """
    turned = F.col("source_entity_id") > F.col("target_entity_id")
    rows = _conflicts(
        new, stored, [turned.alias("turned"), F.col("description").alias("new_text"), F.col("trust").alias("new_source")], [F.col("description").alias("old_text"), F.col("trust").alias("old_source")],
    ).drop("pair", "new_said", "old_said", "new_trust", "old_trust").withColumnsRenamed({"new_source": "new_trust", "old_source": "old_trust"})
    ends = {"source_entity_id": F.when(F.col("turned"), F.col("q")).otherwise(F.col("p")), "target_entity_id": F.when(F.col("turned"), F.col("p")).otherwise(F.col("q"))}
    differ = _named(rows.where("conflict_type = 'inconsistent'").withColumns(ends).drop("p", "q", "turned", "new_text", "old_text"), entities)
    none = F.lit(None).cast("string")
    differ = differ.withColumns({"new_text": none, "old_text": none}).withColumn("reasoning", _reasoning())
    contrary = rows.where("conflict_type = 'contradictory'").withColumns({"source_name": none, "target_name": none}).withColumn("reasoning", _reasoning())
    return differ.select(*CONFLICT, "reasoning").unionByName(contrary.select(*CONFLICT, "reasoning"))


def _named(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows with source_name and target_name, or the ids of ends that have none."""
    for end in ("source", "target"):
        names = entities.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("name").alias(f"{end}_name"))
        rows = join_by_id(rows, names, f"{end}_entity_id", "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", f"{end}_entity_id"))
    return rows


def _reasoning() -> Column:
    # The wording of the text.
    differs = F.format_string(
        "Existing relationship type '%s' differs from new type '%s' between %s and %s.", "old_type", "new_type", "source_name", "target_name",
    )
    negated = F.format_string(
        "Potential contradiction: one description contains negation while the other does not. Existing: '%s' vs New: '%s'", "old_text", "new_text",
    )
    trust = F.format_string(
        " [TRUST] Existing comes from '%s' source (priority %d), new comes from '%s' (priority %d). Review required before overwriting trusted knowledge.",
        F.coalesce("old_trust", F.lit("unknown")), trust_priority(F.col("old_trust")).cast("int"),
        F.coalesce("new_trust", F.lit("unknown")), trust_priority(F.col("new_trust")).cast("int"),
    )
    said = F.when(F.col("conflict_type") == "inconsistent", differs).otherwise(negated)
    return F.concat(said, F.when(F.col("requires_review"), trust).otherwise(""))


def apply_conflict_verdicts(rows: DataFrame) -> DataFrame:
    """Same-type pairs whose model verdict (``reply``) is contradictory, with severity high."""
    r = parse_reply(F.col("reply"), VERDICT_SCHEMA)
    return rows.where(r["verdict"] == "contradictory").withColumn("severity", F.lit("high")).withColumn("conflict_type", F.lit("contradictory"))


def enqueue_reviews(conflicts: DataFrame) -> DataFrame:
    """One pending review for each conflict that needs one."""
    return conflicts.where("requires_review").select(
        content_id(F.col("new_relationship_id"), F.col("old_relationship_id")).alias("review_id"), "new_relationship_id", "old_relationship_id",
        F.lit("pending").alias("review_status"),
    )


def decide_reviews(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews with the decision (review_id, decision, notes) where there is one."""
    named = decisions.select(
        "review_id", F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").alias("decided"), "notes",
    )
    return reviews.join(named, "review_id", "left").withColumn("review_status", F.coalesce("decided", "review_status")).drop("decided")


def list_reviews(reviews: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the reviews (review_id, review_status, created), newest first, all or of one status."""
    some = reviews.where(F.col("review_status") == status) if status else reviews
    return some.orderBy(F.desc("created"), "review_id").offset(offset).limit(limit)


def verification_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")),
        F.max("confidence").alias("best_confidence"),
    )
