"""Structured answers and the evidence that they cite: reading them, checking their contract, and addressing their texts.

An answer is JSON (`SHAPE`). Evidence units are rows (answer key, evidence_id, doc_id, quote, stored): a passage as it was handed to the
answerer and as it is stored now. Both meet by one join on the answer's key; all checks are expressions over one row, as an answer cites
no more units than one retrieval gives.

Defined cases. JSON that can't be read, has a value of another kind, or lacks its status or a claim's kind, document or text is
`schema_invalid`, and nothing else of it is looked at. Missing lists are empty. An evidence id that stands in several rows of an answer is
the smallest of them by document, then the one whose quote has changed. An answer without evidence rows has none. A null quote equals a null
stored quote only. Evidence rows with a null key or id are never cited.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import let, squashed

SHAPE = """status string, summary string, summary_evidence_ids array<string>,
claims array<struct<kind: string, doc_id: string, text: string, evidence_ids: array<string>>>,
conflicts array<struct<topic: string, alternatives: array<struct<doc_id: string, value: string, evidence_ids: array<string>>>>>,
missing_fields array<struct<doc_id: string, field: string, reason: string>>,
listing array<struct<doc_id: string, description: string, evidence_ids: array<string>>>, next_action string"""
#: Ids of passages and of metadata, in brackets within a text.
INLINE_IDS = r"\s*[\[(][EM][0-9]+(?:\s*,\s*[EM][0-9]+)*[\])]"


def texts(*parts: Column) -> Column:
    """The parts that are not null, as an array."""
    return F.array_compact(F.array(*[p.cast("string") for p in parts]))


def listed(items: Column, kind: str = "string") -> Column:
    return F.coalesce(items, F.array().cast(f"array<{kind}>"))


def each(items: Column, body) -> Column:
    """The arrays that body gives for the items, one after the other; none for a null list."""
    return F.coalesce(F.flatten(F.transform(items, body)), F.array().cast("array<string>"))


def without_ids(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, INLINE_IDS, ""))


def collapsed(text: Column) -> Column:
    """Without ids, and each run of white space a space."""
    return F.trim(F.regexp_replace(without_ids(text), r"\s+", " "))


def parsed(answer: Column) -> Column:
    """The answer as a struct of SHAPE; `unreadable` holds the JSON where it breaks the shape."""
    return F.from_json(answer, f"{SHAPE}, unreadable string", {"columnNameOfCorruptRecord": "unreadable"})


def broken(a: Column) -> Column:
    incomplete = lambda c: c.isNull() | c["kind"].isNull() | c["doc_id"].isNull() | c["text"].isNull()
    return a.isNull() | a["unreadable"].isNotNull() | a["status"].isNull() | F.coalesce(F.exists(a["claims"], incomplete), F.lit(False))


def held(items: Column, item: Column) -> Column:
    return F.coalesce(F.array_contains(items, item), F.lit(False))


def status_problem(a: Column) -> Column:
    """What of an answer's content disagrees with its status; null if nothing does."""
    n = F.coalesce(F.size(a["conflicts"]), F.lit(0))
    single = F.exists(a["conflicts"], lambda c: F.coalesce(F.size(c["alternatives"]), F.lit(0)) < 2)
    silent = F.trim(F.coalesce(a["next_action"], F.lit(""))) == ""
    rules = F.when(n <= 0, "conflict_without_conflicts").when(single, "conflict_with_one_alternative").when(silent, "conflict_without_next_action")
    return F.when(a["status"] == "conflicting_evidence", rules)


def problems(a: Column, units: Column, allowed: Column, required: Column) -> Column:
    """All breaches of the contract in the order of its rules, so the first is the one that an answer fails by."""
    compared = F.coalesce(F.size(required), F.lit(0)) > 0
    unit = lambda i: F.array_min(F.filter(units, lambda u: u["evidence_id"] == i))

    def cited(i: Column, doc: Column | None, also: Column | None = None) -> Column:
        def judged(u: Column) -> Column:
            foreign = F.lit(False) if doc is None else ~u["doc_id"].eqNullSafe(doc)
            foreign = foreign if also is None else foreign & ~also(u["doc_id"])
            return F.when(u.isNull(), F.concat(F.lit("unknown_evidence_id: "), i)).when(foreign, F.concat(F.lit("evidence_scope_mismatch: "), i)).when(~u["same"], F.concat(F.lit("evidence_quote_mismatch: "), i))

        return texts(let(unit(i), judged))

    def of_claim(c: Column) -> Column:
        wide = compared & (c["kind"] == "inference")
        refs = each(c["evidence_ids"], lambda i: cited(i, c["doc_id"], lambda d: wide & held(required, d)))
        own = F.exists(c["evidence_ids"], lambda i: unit(i)["doc_id"].eqNullSafe(c["doc_id"]))
        alone = F.when(wide & ~own & (F.size(refs) == 0), F.concat(F.lit("evidence_scope_mismatch: inference cites nothing of "), c["doc_id"]))
        outside = F.when(~held(allowed, c["doc_id"]), F.concat(F.lit("claim_outside_scope: "), c["doc_id"]))
        bare = F.when(F.size(listed(c["evidence_ids"])) == 0, "claim_without_evidence")
        return F.concat(texts(outside, bare), F.when(bare.isNull(), F.concat(refs, texts(alone))).otherwise(texts()))

    def of_alternative(x: Column) -> Column:
        bare = ~held(allowed, x["doc_id"]) | (F.size(listed(x["evidence_ids"])) == 0)
        return F.concat(texts(F.when(bare, "conflict_without_evidence")), each(x["evidence_ids"], lambda i: cited(i, x["doc_id"])))

    def of_missing(m: Column) -> Column:
        outside = F.when(~held(allowed, m["doc_id"]), F.concat(F.lit("missing_field_outside_scope: "), F.coalesce(m["doc_id"], F.lit(""))))
        return texts(outside, F.when(m["reason"] == "source_absence_verified", "source_absence_claimed_from_retrieval"))

    absent = lambda c: c["kind"] == "absence"
    stated = F.filter(a["claims"], lambda c: ~absent(c))
    covered = F.concat(F.coalesce(F.transform(a["claims"], lambda c: c["doc_id"]), texts()), F.coalesce(F.transform(a["missing_fields"], lambda m: m["doc_id"]), texts()))
    sides = F.array_sort(F.array_except(listed(required), covered))
    answered, no_summary = a["status"] == "answered", F.size(listed(a["summary_evidence_ids"])) == 0
    found = F.concat(
        each(F.filter(a["claims"], absent), lambda c: texts(F.when(~held(allowed, c["doc_id"]), F.concat(F.lit("claim_outside_scope: "), c["doc_id"])))),
        texts(status_problem(a)),
        each(stated, of_claim),
        each(a["conflicts"], lambda c: each(c["alternatives"], of_alternative)),
        each(a["missing_fields"], of_missing),
        texts(F.when(answered & (F.coalesce(F.size(stated), F.lit(0)) <= 0), "answered_without_claims")),
        each(a["summary_evidence_ids"], lambda i: cited(i, None)),
        texts(F.when(F.size(sides) > 0, F.concat(F.lit("comparison_side_missing: "), F.array_join(sides, ",")))),
        texts(F.when(answered & no_summary, "summary_without_evidence")),
    )
    return F.when(broken(a), F.array(F.lit("schema_invalid"))).otherwise(found)


def shown(a: Column) -> Column:
    """The answer as it is shown: no ids within texts, and each claim of absence a missing field of its document, unless it is listed there."""
    key = lambda m: F.struct(m["doc_id"], collapsed(m["field"]))
    turned = F.transform(F.filter(a["claims"], lambda c: c["kind"] == "absence"), lambda c: F.struct(c["doc_id"].alias("doc_id"), collapsed(c["text"]).alias("field"), F.lit("not_found_in_context").alias("reason")))
    turned = F.array_distinct(F.filter(turned, lambda m: m["field"] != ""))
    new = F.filter(turned, lambda m: ~F.coalesce(F.exists(a["missing_fields"], lambda x: key(x).eqNullSafe(key(m))), F.lit(False)))
    kept = F.transform(F.filter(a["claims"], lambda c: c["kind"] != "absence"), lambda c: c.withField("text", without_ids(c["text"])))
    fields = "struct<doc_id: string, field: string, reason: string>"
    return a.withField("summary", without_ids(a["summary"])).withField("claims", kept).withField("missing_fields", F.concat(listed(a["missing_fields"], fields), listed(new, fields)))


def validated(answers: DataFrame, evidence: DataFrame, key: str, answer: str, allowed: str, required: str) -> DataFrame:
    """answers with their breaches (`problems`, in the order of the rules; the first also as `problem`) and, where there is none, the
    answer as it is shown (`shown`)."""
    same = F.col("quote").eqNullSafe(F.col("stored"))
    units = evidence.where(F.col(key).isNotNull() & F.col("evidence_id").isNotNull()).groupBy(F.col(key).alias("unit_key")).agg(F.collect_set(F.struct("evidence_id", "doc_id", same.alias("same"))).alias("units"))
    rows = answers.withColumn("parsed_answer", parsed(F.col(answer))).join(units, F.col(key) == F.col("unit_key"), "left")
    own = listed(F.col("units"), "struct<evidence_id: string, doc_id: string, same: boolean>")
    rows = rows.withColumn("problems", problems(F.col("parsed_answer"), own, F.col(allowed), F.col(required)))
    first = F.try_element_at("problems", F.lit(1))
    return rows.withColumn("problem", first).withColumn("shown", F.when(first.isNull(), shown(F.col("parsed_answer")))).drop("unit_key", "units", "parsed_answer")


def cited_ids(a: Column) -> Column:
    """All ids that an answer cites, each once, in order: summary, claims, alternatives of conflicts, listed rows."""
    ids = lambda x: listed(x["evidence_ids"])
    return F.array_distinct(F.concat(listed(a["summary_evidence_ids"]), each(a["claims"], ids), each(a["conflicts"], lambda c: each(c["alternatives"], ids)), each(a["listing"], ids)))


def answer_fields(a: Column) -> Column:
    """array<struct<field, text>> of an answer's texts that are not empty: summary, next_action, claim.0, conflict.0.1, missing.0, listing.0."""

    def numbered(items: Column, name: str, part: str) -> Column:
        named = F.transform(items, lambda x, k: F.struct(F.concat(F.lit(f"{name}."), k.cast("string")).alias("field"), x[part].alias("text")))
        return listed(named, "struct<field: string, text: string>")

    single = lambda name: F.array(F.struct(F.lit(name).alias("field"), a[name].alias("text")))
    sides = lambda c, k: F.transform(c["alternatives"], lambda x, j: F.struct(F.concat_ws(".", F.lit("conflict"), k.cast("string"), j.cast("string")).alias("field"), x["value"].alias("text")))
    conflicts = listed(F.flatten(F.transform(a["conflicts"], lambda c, k: listed(sides(c, k), "struct<field: string, text: string>"))), "struct<field: string, text: string>")
    every = F.concat(single("summary"), single("next_action"), numbered(a["claims"], "claim", "text"), conflicts, numbered(a["missing_fields"], "missing", "field"), numbered(a["listing"], "listing", "description"))
    return F.filter(every, lambda f: F.length(f["text"]) > 0)


def field_text(a: Column, field: Column) -> Column:
    """The text of one field; null if the answer has none of that name."""
    return F.try_element_at(F.transform(F.filter(answer_fields(a), lambda f: f["field"] == field), lambda f: f["text"]), F.lit(1))


def document_text(a: Column, doc: Column, single: Column) -> Column:
    """What an answer states of one document; its summary, which names no document, only where one document is asked about."""
    claims = each(F.filter(a["claims"], lambda c: c["doc_id"] == doc), lambda c: texts(c["text"]))
    values = each(a["conflicts"], lambda c: each(F.filter(c["alternatives"], lambda x: x["doc_id"] == doc), lambda x: texts(x["value"])))
    return F.array_join(F.filter(F.concat(texts(F.when(single, a["summary"])), claims, values), lambda t: t != ""), " ")


def verbatim(claim: Column, cited: Column, least: int = 4) -> Column:
    """Whether a claim of `least` characters or more stands in a text word for word, white space apart."""
    return F.coalesce((F.length(squashed(claim)) >= least) & squashed(cited).contains(squashed(claim)), F.lit(False))


def cited_segments(text: Column, quote: Column, start: Column) -> Column:
    """array<struct<text, cited>>: a text cut at its quote. A recorded start (from 0) holds if the quote stands there; otherwise the first place
    does; a quote that is empty or nowhere marks nothing. Empty segments are left out."""
    n = F.length(quote)
    recorded = F.when((start >= 0) & (F.substr(text, start + 1, n) == quote), start)
    at = F.when(n > 0, F.coalesce(recorded, F.nullif(F.instr(text, quote) - 1, F.lit(-1))))
    part = lambda t, cited: F.struct(t.alias("text"), F.lit(cited).alias("cited"))
    cut = lambda p: F.when(p.isNull(), F.array(part(text, False))).otherwise(F.array(part(F.substr(text, F.lit(1), p), False), part(quote, True), part(F.substr(text, p + n + 1), False)))
    return F.filter(let(at, cut), lambda s: F.length(s["text"]) > 0)


def mentioned(links: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """(group, member, others): each member with the other members of its group in order. A group's list is bounded by what one table or
    requirement was split into."""
    lists = links.where(F.col(member).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return lists.select(*group, F.explode("members").alias(member), "members").withColumn("others", F.array_remove("members", F.col(member))).drop("members")
