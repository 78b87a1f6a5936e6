"""The registered queries of this subpackage, with SQL to check them by where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import bpe, codes, curve, decontaminate, divergence, licenses, linededup, minhash, piecetable, pii, quality_model, quality_rules, sharding
from foliograph.llm.store import stored

QUERIES, ORACLES = {}, {}
#: Bytes of text in a shard.
SHARD_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return register


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the byte-level ranks and decoded again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, tasks=bpe.scan_tasks(docs), drop_text=True), ranks)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def _licenses_sql() -> str:
    known = ", ".join(f"('{plain}', '{name}')" for plain, name in licenses.SENTENCES.items())
    rest, names, steps = "seq", [], []
    for n, (name, rule) in enumerate(licenses.RULES):
        wanted = "".join(f" {s}. " for s in rule)
        steps.append(f"r{n} AS (SELECT *, contains({rest}, '{wanted}') AS hit{n}, replace({rest}, '{wanted}', ' | ') AS rest{n} FROM {f'r{n - 1}' if n else 'seqs'})")
        rest = f"rest{n}"
        names.append(f"CASE WHEN hit{n} AND NOT ({' OR '.join([f'hit{m}' for m in range(n) if licenses.RULES[m][0] == name] or ['false'])}) THEN '{name}' END")
    return f"""
WITH cut AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[.;:!?]+([ \\t\\r\\n]+|\\z)', chr(10), 'g'), chr(10)) AS l FROM documents)),
plain AS (SELECT doc_id, i, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS p FROM cut),
known(p, sentence) AS (VALUES {known}),
seqs AS (SELECT doc_id, count(*) AS n_sentences, string_agg(' ' || sentence || '. ', '' ORDER BY i) AS seq FROM plain JOIN known USING (p) GROUP BY doc_id),
{", ".join(steps)}
SELECT doc_id, n_sentences, concat_ws(' ', {", ".join(names)}) AS licenses, length({rest}) - length(replace({rest}, '.', '')) AS leftover FROM r{len(licenses.RULES) - 1}"""


@query(_licenses_sql())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document that has a known licence sentence."""
    return licenses.licenses(table(spark, sf_dir, "documents"))


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the label model's verdict for every document."""
    counted = stored(quality_rules.counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-counts")
    judged = quality_rules.judge(counted, quality_rules.fit(counted))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", F.round("quality", 9).alias("quality"))


@query("""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), firsts AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, i, l, coalesce(owner < doc_id, false) AS gone FROM lines LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds, removed."""
    kept = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", F.col("n_dropped").cast("bigint").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: 3-word shingles, 85 per cent."""
    found = minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


@query()
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document, within 8 per cent of edits."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT), 60, '0') AS h FROM documents),
d AS (SELECT *, unnest(range(0, 61)) AS bits FROM r),
s AS (SELECT doc_id, n_bytes, h, bits, sum(n_bytes) OVER w AS b, count(*) OVER w AS c FROM d WINDOW w AS (PARTITION BY bits, substr(h, 1, bits)))
SELECT doc_id, n_bytes, min(bits)::INTEGER AS depth, substr(h, 1, min(bits)) AS shard, 0 AS page
FROM s WHERE b <= {SHARD_BYTES} OR c = 1 GROUP BY doc_id, n_bytes, h""")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document under a limit of a megabyte."""
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query()
def op10_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as directly addressable codes and read back."""
    tokenizer = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return codes.digests(codes.read(codes.written(table(spark, sf_dir, "documents"), tokenizer, end_id=1)))


@query()
def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


@query()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).drop("text")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
e AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
  ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o""")
def op11_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text rebuilt from that."""
    made = piecetable.fim(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = made.withColumn("output", piecetable.rendered(F.col("pieces"), F.col("text")))
    both = piecetable.hashed(shown.withColumn("back", piecetable.restored(F.col("output"), F.col("form"))), {"output_sha256": ("pieces", "text"), "restored_sha256": ("back", "output")})
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
words AS (SELECT id, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS item
  FROM (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS raw FROM docs)),
kept AS (SELECT lang, item FROM words GROUP BY lang, item HAVING count(DISTINCT id) >= 30),
counts AS (SELECT lang, source, item, count(*) AS c FROM words JOIN kept USING (lang, item) GROUP BY lang, source, item),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.item, coalesce(c.c, 0) AS c FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item),
whole AS (SELECT lang, item, sum(c) AS c FROM cells GROUP BY lang, item),
priced AS (SELECT lang, source, item, c, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w)::HUGEINT AS p FROM cells WINDOW w AS (PARTITION BY lang, source)),
base AS (SELECT lang, item, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w)::HUGEINT AS q FROM whole WINDOW w AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
terms AS (SELECT lang, source, 'term' AS part, item, (p - q)::BIGINT AS value FROM priced JOIN base USING (lang, item) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""")
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language, and the terms that each uses most beyond its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query()
def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in full sequences of 2048 ids, neighbours on a Hilbert curve together."""
    tokenizer = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return curve.digests(curve.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, end_id=1))
