"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, html_extract, lexical_search, line_dedup, minhash, quality_rules, rule_classifier, sharding, spm_dropout, suffix_dedup, tandem_runs, warc
from .scratch import new_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op4_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_bytes=100)
    read = warc.read_archive(spark, path)
    return read.select(F.col("page").alias("page_id"), "payload_bytes", F.when(F.col("verified"), F.col("digest")).alias("payload_digest"), "record_type", "refers_to")


def op7_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50, with_bytes=False)


def op9_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rule_classifier.train(docs, table(spark, sf_dir, "labels"), max_rows=20_000)
    return rule_classifier.score_documents(docs, model, threshold=0.3)


def op10_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_dropout.round_trips(table(spark, sf_dir, "documents"), dropout=0.1, seed=1)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def periodic_tail(doc_id: int | None, text: str) -> list[bytes]:
    """The words of a text; in one of ten documents, chosen by id, all from some word on repeat with one period."""
    words = tandem_runs.words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return words[:first] + [words[first + k % period] for k in range(n - first)]


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tandem_runs.find_runs(table(spark, sf_dir, "documents"), words=periodic_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("first"), (-r["period"]).alias("short"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.first")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"), F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_decontamination,
        op2_minhash_near_dedup,
        op3_hash_tree_sharding,
        op4_line_block_extraction,
        op5_line_dedup,
        op6_warc_archive,
        op7_line_frequency_quality,
        op8_suffix_dedup,
        op9_rule_ensemble_quality,
        op10_sentencepiece_dropout,
        op11_exact_dedup,
        op12_tandem_runs,
        op13_lexical_search,
    )
}


def _draw_sql(node: str) -> str:
    return f"-ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|{node}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _choice_sql(options: list[tuple[str, float, str]]) -> str:
    if len(options) == 1:
        return options[0][2]
    out = options[-1][2]
    for i in range(len(options) - 2, -1, -1):
        mine = f"{_draw_sql(options[i][0])} / {options[i][1]}"
        test = " AND ".join(f"{mine} <= {_draw_sql(name)} / {weight}" for name, weight, _ in options[i + 1 :])
        out = f"CASE WHEN {test} THEN {options[i][2]} ELSE {out} END"
    return out


def _place_sql(name: str, node) -> str:
    options = []
    for child, below in node.items():
        path = f"{name}/{child}"
        options.append((path, sharding._weight(below), _place_sql(path, below) if isinstance(below, dict) else str(child)))
    return _choice_sql(options)


def oracle_sql() -> dict[str, str]:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ascii_lower = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op3_hash_tree_sharding": f"""
            WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
            crc_table AS (SELECT list(c ORDER BY i) AS crc_list FROM bits WHERE k = 8),
            placed AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, text,
                CAST({_place_sql("", sharding.standard_tree(8))} AS INTEGER) AS shard,
                CASE WHEN {_draw_sql("/tree8")} / 8 <= {_draw_sql("/added/rack0/8")} THEN CAST({_place_sql("", sharding.standard_tree(8))} AS INTEGER) ELSE 8 END AS grown_shard, crc_list FROM documents, crc_table)
            SELECT doc_id, size, {CRC32_SQL.format(text="coalesce(text, '')")} AS text_crc32, 'key' AS law, shard,
                row_number() OVER (PARTITION BY shard ORDER BY doc_id, size) - 1 AS slot, grown_shard FROM placed""",
        "op5_line_dedup": f"""
            WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
            k AS (SELECT doc_id, pos, x AS line, {ascii_lower.replace("x,", f"trim(x, {blanks}),")} AS k FROM l),
            s AS (SELECT k, min(doc_id) AS keeper FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
            m AS (SELECT doc_id, pos, line, s.k IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN s USING (k))
            SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
        "op6_warc_archive": """
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to
            FROM (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first, strlen(h) >= 100 AND page_id > min(page_id) OVER (PARTITION BY h) AS revisit
                  FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""",
        "op11_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\x09-\\x0D]+', ' ', 'g')) AS h FROM documents),
            g AS (SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""",
        "op13_lexical_search": f"""
            WITH d AS (SELECT doc_id, unnest(regexp_extract_all({ascii_lower.replace("x,", "text,")}, '{TERM_SQL}')) AS t FROM documents),
            i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({ascii_lower.replace("x,", "text,")}, '{TERM_SQL}')) AS t FROM benchmark),
            p AS (SELECT doc_id, t, count(*) AS tf, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS n FROM d GROUP BY doc_id, t),
            z AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM d),
            w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY t, docs),
            s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score FROM i JOIN p USING (t) JOIN w USING (t), z GROUP BY item_id, doc_id)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
            QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    }


#: A term of the lexical search.
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: CRC-32 of a text, byte by byte with a table that a recursive query builds.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))),
                lambda c, b: xor(c >> 8, crc_list[1 + (xor(c, b) & 255)])), 4294967295)"""
