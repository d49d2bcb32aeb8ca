"""The registered queries of the operators, with the SQL they agree with where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, fingerprint, html, language, licenses, near, packing, quality, repair, suffix, toxicity, whitening
from .text import held_out, table


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), packing.tokenizer_source())


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, read back from what was written. One more conversation says
    the template's own control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    made = chat.format_conversations(rows.unionByName(hard))
    back = made.withColumn("back", chat.read_back("output", "turns"))
    return back.select("conv_id", "back.*", F.length("output").cast("long").alias("formatted_chars"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and their likeness."""
    return fingerprint.with_neighbour(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels, usable=~fold)
    scored = quality.with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their 4-word shingles."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


OP4_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select doc_id, case when len(w) = 0 then []
    when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words
), sized as (select doc_id, s, len(s) as n from shingles),
flat as (select doc_id, n, unnest(s) as g from sized),
common as (
  select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c
  from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id
  group by all
), links as (
  select x, y from common where 100 * c >= 80 * (nx + ny - c)
), both_ways as (
  select x, y from links union select y, x from links
), reach(node, low) as (
  select doc_id, doc_id from sized
  union
  select e.y, r.low from reach r join both_ways e on e.x = r.node where r.low < e.y
)
select s.doc_id, s.n as n_shingles, m.low as component_id, s.doc_id = m.low as kept
from sized s join (select node, min(low) as low from reach group by node) m on m.node = s.doc_id
"""

def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels, usable=~fold)
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, its distance and its place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without 50-byte strings of earlier documents."""
    done = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return done.select(
        "doc_id", F.col("sa_bytes").alias("n_bytes"), F.col("sa_removed").alias("n_removed"),
        F.col("sa_spans").alias("n_spans"), F.sha2("sa_kept", 256).alias("kept_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs, usable=~fold & F.col("doc_id").isNotNull())
    found = language.with_language(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", fold.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.with_text(pages, html.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the leading components of the distinct vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    share = F.array(*(F.lit(float(v / model.trace)) for v in model.values)).cast("array<double>")
    return whitening.whitened(rows, model).select(
        "vec_id", "wh_deviation", F.posexplode("wh_values").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("wh_deviation").try_cast("long").alias("deviation"), "whitened",
        F.get(share, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every document."""
    done = licenses.with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("licenses.found")
    starts = F.transform(F.filter(found, lambda d: d["kind"] == "base"), lambda d: d["first"])
    return done.select(
        "doc_id", F.col("licenses.words").alias("n_words"), F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.label_list(found, F.lit("base")).alias("base_labels"), licenses.label_list(found).alias("labels"),
        F.col("licenses.score").alias("score"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with planted faults, repaired."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair.Repair(repair.damaged(rows), rows.select("conv_id")).summaries()
    return done.withColumnRenamed("sha256", "repaired_sha256")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_suffix_dedup, op4_near_duplicates, op5_language, op6_packing, op7_chat, op8_fingerprint, op9_quality, op10_html, op11_whitening, op12_licenses, op13_repair)}
ORACLES = {"op4_near_duplicates": OP4_SQL}


def all_queries() -> dict:
    """Queries of the operators and the pipeline over all of them that it uses."""
    import corpus_pipeline

    return dict(QUERIES) | {"pipeline": corpus_pipeline.run}


def all_oracles() -> dict:
    return dict(ORACLES)
