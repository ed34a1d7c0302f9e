"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .language import fit_language_model, identify_language
from .licenses import scan_licenses
from .manifest import fold, leaf_digest, merkle_manifest, proof
from .mixing import lm_scores
from .pieces import encode_pieces
from .quality_rank import GOOD, fit_quality_ranker, rank_quality
from .quality_rules import quality_rules
from .runs import periodic_runs, with_planted_runs
from .samples import remainder
from .sharding import shard_rows
from .simhash import simhash_components
from .substring import drop_repeats
from .warc import audit, damaged, warc_records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder("doc_id", 10) == 0
    out = lm_scores(_table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(remainder("doc_id", 5) != 0))
    out = identify_language(docs, model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op6_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = rank_quality(docs, fit_quality_ranker(docs, labels.where(remainder("doc_id", 5) != 0)))
    return out.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of ``pages`` that was damaged at known places."""
    records = warc_records(_table(spark, sf_dir, "pages"))
    return audit(records, damaged(records)).withColumnRenamed("id", "page_id")


def op11_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(docs, 40, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    seen = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaf = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    out = merkle_manifest(docs.select(F.col("source").alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf(F.col("text")).alias("leaf"), leaf(seen).alias("seen")))
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words"
    )


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_sentencepiece": op2_sentencepiece, "op3_substring_dedup": op3_substring_dedup, "op4_lm_mixing": op4_lm_mixing, "op5_language": op5_language, "op6_quality_rank": op6_quality_rank, "op7_simhash": op7_simhash, "op8_decontaminate": op8_decontaminate,
    "op9_licenses": op9_licenses, "op10_warc_fixity": op10_warc_fixity,
    "op11_slots": op11_slots, "op12_manifest": op12_manifest, "op13_runs": op13_runs}
#: levels of trees that the SQL below spells out
_MOST = 16
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i,
          list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def _crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, with ``crc_table`` in reach."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)]), 4294967295))"


def _tree_sql(name: str, nodes: str, leaves: str) -> str:
    """Runs of three of every level over ``nodes(tree, place, h)``, then ``leaves(tree,
    place, acc, proof, ...)`` folded with their siblings, level by level."""
    out = []
    for k in range(_MOST):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT tree, place // 3 AS run, list(h ORDER BY place) AS hs, any_value(n) = 1 AS alone FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}) GROUP BY ALL)")
        nodes = f"(SELECT tree, run AS place, CASE WHEN alone THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})"
    for k in range(_MOST):
        low, high = "array_to_string(hs[1:place % 3], '')", "array_to_string(hs[place % 3 + 2:], '')"
        new = f"CASE WHEN alone THEN acc ELSE sha256({low} || acc || {high}) END AS acc, CASE WHEN alone THEN proof ELSE proof || {low} || {high} END AS proof, place // 3 AS place"
        out.append(f"{name}f{k} AS (SELECT f.* REPLACE ({new}) FROM {leaves if not k else name + f'f{k - 1}'} AS f JOIN {name}r{k} AS r ON f.tree = r.tree AND f.place // 3 = r.run)")
    return ",\n      ".join([*out, f"{name} AS (SELECT * FROM {name}f{_MOST - 1})", f"{name}_top AS (SELECT tree, h FROM {nodes})"])


ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
      WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
      k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS rn FROM p),
      gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM k WHERE rn > 1),
      words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
      kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
      FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_warc_fixity": r"""
      WITH r AS (SELECT page_id AS id, encode(E'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || page_id || E'>\r\nWARC-Target-URI: ' || coalesce(url, '')
          || E'\r\nContent-Type: text/html\r\nContent-Length: ' || octet_length(encode(coalesce(html, ''))) || E'\r\n\r\n' || coalesce(html, '') || E'\r\n\r\n') AS rec FROM pages),
      b AS (SELECT id, CASE WHEN id % 97 = 0 THEN rec[:octet_length(rec) - 6] || encode(E'??\r\n\r\n') WHEN id % 131 = 0 THEN rec[:octet_length(rec) // 2] ELSE rec END AS rec FROM r WHERE id % 211 <> 0),
      la AS (SELECT id, octet_length(rec) AS length, sha256(rec) AS hash, CAST(sum(octet_length(rec)) OVER (PARTITION BY id // 1024 ORDER BY id) - octet_length(rec) AS BIGINT) AS off FROM r),
      lb AS (SELECT id, octet_length(rec) AS length, sha256(rec) AS hash, CAST(sum(octet_length(rec)) OVER (PARTITION BY id // 1024 ORDER BY id) - octet_length(rec) AS BIGINT) AS off FROM b)
      SELECT la.id AS page_id, 0 AS copy, CASE WHEN lb.id IS NULL THEN 'missing' ELSE 'changed' END AS kind, la.off AS left_offset, la.length AS left_length, la.hash AS left_hash,
        lb.off AS right_offset, lb.length AS right_length, lb.hash AS right_hash FROM la LEFT JOIN lb USING (id) WHERE lb.id IS NULL OR la.hash <> lb.hash""",
    "op11_slots": rf"""
      WITH RECURSIVE {_CRC_TABLE},
      d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, CAST({_crc_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents, crc_table),
      p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, text_crc32, size) - 1) // 1024 * 1024 AS piece FROM d),
      v AS (SELECT *, CAST('0x' || substr(md5(concat_ws(',', coalesce(CAST(doc_id AS VARCHAR), ''), text_crc32, size, piece)), 1, 8) AS BIGINT) % 4096 AS virtual_slot FROM p),
      loads AS (SELECT s.virtual_slot, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT unnest(range(4096)) AS virtual_slot) AS s LEFT JOIN v USING (virtual_slot) GROUP BY ALL),
      ordered AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS nth FROM loads),
      fold(nth, held, shard) AS (
        SELECT CAST(0 AS BIGINT), list_transform(range(40), lambda k: [CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(k AS BIGINT)]), CAST(NULL AS BIGINT)
        UNION ALL
        SELECT o.nth, list_transform(held, lambda x: CASE WHEN x[3] = list_min(held)[3] THEN [x[1] + o.bytes, x[2] + 1, x[3]] ELSE x END), list_min(held)[3] FROM fold JOIN ordered AS o ON o.nth = fold.nth + 1),
      placed AS (SELECT v.*, CAST(f.shard AS INTEGER) AS shard FROM v JOIN ordered AS o USING (virtual_slot) JOIN fold AS f ON f.nth = o.nth)
      SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size, piece) - 1 AS slot,
        CAST(NULL AS INTEGER) AS grown_shard, virtual_slot, 1 AS map_version FROM placed""",
    "op12_manifest": rf"""
      WITH {_CRC_TABLE},
      d AS (SELECT doc_id, source, text, CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, E'\n', '') ELSE text END AS seen,
          concat_ws('', {", ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))}) AS head FROM documents, crc_table),
      l AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS place,
          sha256(head || {{0}}) AS leaf, sha256(head || {{1}}) AS acc, '' AS proof FROM d),
      {_tree_sql("low", "(SELECT tree, place, leaf AS h FROM l)", "l")},
      {_tree_sql("top", "(SELECT 0 AS tree, tree AS place, h FROM low_top)", "(SELECT doc_id, leaf, tree AS own, 0 AS tree, tree AS place, acc, proof FROM low)")}
      SELECT doc_id, leaf, low_top.h AS subroot, top_top.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = top_top.h AS verified
      FROM top JOIN low_top ON low_top.tree = own CROSS JOIN top_top""".replace("{0}", "coalesce(octet_length(encode(text)) || ':' || text, '-')").replace("{1}", "coalesce(octet_length(encode(seen)) || ':' || seen, '-')"),
}
