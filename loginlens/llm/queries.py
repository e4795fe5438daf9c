"""The registered queries of these operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.llm import ann, bpe, decontam, fim, lines, lm, pii, quality, shard, simhash, suffix, warc, whiten
from loginlens.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "byte_bpe_multi_50k.tiktoken"
SHARDS = 40
ACCEPTED_SCORE = 0.3
#: Lines of five words or more are linked from this edit similarity on; one word in five may differ.
LINE_SIMILARITY = 0.8


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select(F.col("key").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


def op2_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = ann.nearest_by_inner_product(rows, rows.filter("vec_id % 20 = 0"), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (F.size("contamination.spans") > 0).alias("contaminated"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    planned = warc.revisit_plan(pages, "page_id", "payload")
    records = planned.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(F.col("__first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(F.col("__first").isNull(), F.col("payload")).alias("payload"),
        F.col("__sha1").alias("sha1"),
        F.when(F.col("__first").isNotNull(), name(F.col("__first"))).alias("refers_to"),
    )
    archives = stored(warc.write_archives(records), "archives")
    page = lambda c: F.when(F.length(c) > 9, F.substring(c, 10, 30).cast("long"))
    read = stored(
        warc.read_archives(archives).select(
            page(F.col("record_id")).alias("page_id"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            "payload_digest",
            "record_type",
            page(F.col("refers_to")).alias("refers_to"),
        ),
        "records",
    )
    responses, revisits = read.filter("record_type = 'response'"), read.filter("record_type = 'revisit'")
    # A revisit's payload is that of its response.
    referred = revisits.select(F.col("refers_to").alias("page_id")).distinct()
    sizes = responses.join(referred, "page_id", "left_semi").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"))
    resolved = revisits.drop("payload_bytes").join(sizes, "refers_to", "left").select(read.columns)
    return responses.unionByName(resolved)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.add_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED_SCORE).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"], plain=bpe.PLAIN)
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    decoded = bpe.decode(digests, ranks, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.fit(docs), keep=["doc_id"])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicate_lines(docs, similarity=LINE_SIMILARITY).select("doc_id", "lines", "lines_removed", "text")


def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard.assign_shards(rows, "doc_id", [1.0] * SHARDS)
    placed = shard.assign_shards(placed, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    numbered = shard.number_in_shards(placed, ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix.remove_repeats(docs, length=200)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("fim.units").alias("n"),
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whiten.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(e) for e in (model.explained if model else [])]).cast("array<double>")
    long = rows.select("vec_id", "whitening.deviation", F.posexplode("whitening.whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.rows if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.fit(docs.filter(~lm.held_out(F.col("doc_id"))))
    scored = lm.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        lm.held_out(F.col("doc_id")).alias("held_out"),
        "lm.n_tokens",
        "lm.n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        F.col("lm.base").alias("base_score"),
        "lm.score",
    )


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simhash, op2_stable_projections, op3_decontamination, op4_warc, op5_quality, op6_byte_bpe, op7_personal_data, op8_line_dedup, op9_rendezvous, op10_suffix_array, op11_fill_in_middle, op12_whitening, op13_language_model)}

ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
        ), responses AS (
            SELECT payload, max(page_id) AS response FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload
        )
        SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN response <> page_id THEN response END AS refers_to
        FROM payloads LEFT JOIN responses USING (payload)
    """,
    "op11_fill_in_middle": """
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), drawn AS (
            SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS u, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS v,
                   ('0x' || substr(h, 17, 8))::BIGINT % 100 AS p, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS s
            FROM texts
        ), cut AS (
            SELECT *, least(u, v) AS a, greatest(u, v) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain'
                        WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ), parts AS (
            SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
}
