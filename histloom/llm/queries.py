"""Queries of the operators for text, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from histloom.llm import credentials, handwritten, identities, leakage, packing, spans, subjects
from histloom.queries.common import file_changes, table

CAPACITY = 2048


def _entities(spark, d):
    c = table(spark, d, "contributors")
    return identities.resolve(c, F.col("contributor_id"), F.col("name"), F.col("email"))


def p2_found(spark, d):
    return identities.linked_pairs(_entities(spark, d)).withColumnsRenamed({"a": "contributor_a", "b": "contributor_b"})


def p2_entities(spark, d):
    return identities.with_links(_entities(spark, d)).withColumnsRenamed({"id": "contributor_id", "entity": "entity_id"})


def _diffs(spark, d):
    c = table(spark, d, "commits").filter("hash is not null")
    return c.select("hash", F.posexplode("modified_files.diff").alias("file_pos", "diff"))


def _spans(spark, d):
    return spans.shared_spans(_diffs(spark, d), F.col("hash"), ["hash", "file_pos"], F.col("diff"))


def p4_found(spark, d):
    return _spans(spark, d)


def p4_shares(spark, d):
    part = _spans(spark, d).groupBy("hash", "file_pos").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"), F.count(F.lit(1)).alias("runs"))
    sizes = _diffs(spark, d).groupBy("hash", "file_pos").agg(F.max(F.coalesce(F.length("diff"), F.lit(0))).alias("chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return sizes.join(part, ["hash", "file_pos"], "left").select(
        "hash", "file_pos", "chars", shared.alias("shared_chars"), F.coalesce("runs", F.lit(0)).alias("runs"), F.when(F.col("chars") > 0, shared / F.col("chars")).otherwise(0.0).alias("share")
    )


def _reasons(spark, d):
    f = file_changes(table(spark, d, "commits"), "new_path", "old_path", "filename", "diff", also=("project_name",))
    return handwritten.classify(f, F.col("project_name"), F.col("new_path"), F.col("old_path"), F.col("filename"), F.col("diff"), ["hash", "file_pos"])


def p5_found(spark, d):
    return _reasons(spark, d).select("hash", "file_pos")


def p5_reasons(spark, d):
    return _reasons(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("changes"))


def _credentials(spark, d):
    f = file_changes(table(spark, d, "commits"), "filename", "diff")
    return credentials.scan(f, F.col("filename"), F.col("diff"), ["hash", "file_pos"])


def p6_found(spark, d):
    return _credentials(spark, d).select("hash", "file_pos", "line_no")


def p6_redacted(spark, d):
    return _credentials(spark, d).groupBy("hash", "file_pos").agg(F.count(F.lit(1)).alias("credentials"), F.max("redacted").alias("diff"))


def p8_containers(spark, d):
    t = table(spark, d, "documents")
    counted = packing.with_token_counts(t, F.col("doc_id"), F.col("text"))
    return packing.pack(counted, F.col("doc_id"), F.col("tokens"), CAPACITY).withColumnRenamed("item_id", "doc_id").withColumnRenamed("size", "tokens")


def _leaks(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leakage.leaked(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))


PASSAGE = 13


def p9_found(spark, d):
    return _leaks(spark, d).filter(F.col("longest") >= PASSAGE).select("doc_id", "item_id")


def p9_items(spark, d):
    return _leaks(spark, d).filter(F.col("longest") >= PASSAGE).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("passages").alias("passages"), F.max("longest").alias("longest"))


def p9_edited(spark, d):
    """Documents in which an item stands with changes only."""
    return _leaks(spark, d).filter(F.col("longest") < PASSAGE).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def _subjects(spark, d):
    names = sorted(r[0] for r in table(spark, d, "subjects").filter("subject is not null").distinct().collect())  # a short fixed list
    docs, labels = table(spark, d, "documents"), table(spark, d, "subject_labels")
    return subjects.assign(docs, F.col("doc_id"), F.col("text"), labels, F.col("doc_id"), F.col("subject"), names)


def p10_found(spark, d):
    return _subjects(spark, d).select("doc_id", "subject")


def p10_shares(spark, d):
    n = table(spark, d, "documents").agg(F.countDistinct("doc_id").alias("n"))
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents")).crossJoin(F.broadcast(n)).select("subject", "documents", (F.col("documents") / F.col("n")).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_entities, p4_found, p4_shares, p5_found, p5_reasons, p6_found, p6_redacted, p8_containers, p9_found, p9_items, p9_edited, p10_found, p10_shares)
}

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
SQL = {
    "p9_found": rf"""
with i as (select item_id, {_WORDS} w from eval_items), d as (select doc_id, {_WORDS} w from documents),
     wi as (select item_id, array_to_string(w[k : k + 12], ' ') g from i, lateral (select unnest(range(1, len(w) - 11)) k)),
     wd as (select doc_id, array_to_string(w[k : k + 12], ' ') g from d, lateral (select unnest(range(1, len(w) - 11)) k))
select distinct doc_id, item_id from wd join wi using (g)""",
    "p9_items": rf"""
with i as (select item_id, {_WORDS} w from eval_items), d as (select doc_id, {_WORDS} w from documents),
     wi as (select item_id, k q, array_to_string(w[k : k + 12], ' ') g from i, lateral (select unnest(range(1, len(w) - 11)) k)),
     wd as (select doc_id, k p, array_to_string(w[k : k + 12], ' ') g from d, lateral (select unnest(range(1, len(w) - 11)) k)),
     m as (select doc_id, item_id, p, q from wd join wi using (g)),
     r as (select *, p - row_number() over (partition by doc_id, item_id, p - q order by p) isle from m), l as (select doc_id, item_id, count(*) + 12 n from r group by doc_id, item_id, p - q, isle),
     a as (select doc_id, item_id, count(distinct p) passages from m group by all), b as (select doc_id, item_id, max(n) longest from l group by all)
select item_id, count(*) documents, sum(passages) passages, max(longest) longest from a join b using (doc_id, item_id) group by item_id""",
}
