"""The registered queries of this package and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``; null and wordless texts have no shingles and are their own component."""
    from .ngramjoin import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _rest(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string")) % modulus


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``; null texts and those without a letter are ``und``, null ids are neither held out nor learned from."""
    from . import langid

    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_rest("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    dictionaries = langid.learn(docs.filter(_rest("doc_id", 5) != 0))
    found = langid.identify(docs.select("doc_id", held, "text"), dictionaries, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``; a null text is its end alone, null ids are neither held out nor learned from."""
    from .lmscore import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each row of ``documents``; a null text is its closing id alone."""
    import public_tokenizers

    from . import packing

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every row of ``documents``; a null text scores as an empty one, a null id is not held out."""
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(_rest("doc_id", 3) != 1)
    model = toxicity.fit(toxicity.sample(docs, labels))
    held = F.coalesce(_rest("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return toxicity.score(docs.select("doc_id", held, "text"), model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation, null ids being one; null texts and roles count as empty."""
    from . import chat

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    events = turns.unionByName(extra).withColumn("seq", F.col("turn")).withColumn("kind", F.lit("message"))
    return chat.read_back(chat.format_chats(events))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, told apart by file and place there, whatever its doc_id."""
    from .fingerprint import edited_likeness
    from .workspace import Workspace

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return edited_likeness(docs, Workspace(spark, "fingerprints"), ["file", "row"])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` after eight arrivals, compaction and vacuum; null texts digest as empty ones."""
    from .sharding import TARGET, ShardStore, plan
    from .workspace import Workspace

    store = ShardStore(spark, Workspace(spark, "shards").path("store"))
    docs = _table(spark, sf_dir, "documents")
    # an eighth of a split of 128 MB is well below the target, so there are small shards to merge
    for arrival in range(8):
        store.append(docs.filter(F.coalesce(_rest("doc_id", 8), F.lit(0)) == arrival))
    before = store.manifest()["shards"]
    store.compact()
    if plan(before, TARGET) and len(store.manifest()["shards"]) >= len(before):
        raise RuntimeError("the committed manifest holds no merged shards")
    store.vacuum()
    return store.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lang", "source", "n_chars")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that align; null and empty texts match nothing."""
    from .decontam import matches

    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``; a null text has no words, a null id counts as the greatest."""
    from .substr import repeats

    return repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``; null texts count as empty and stay plain, a null id is hashed as an empty one."""
    from .fim import fill_in_middle, restored

    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    exact = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), exact)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, told apart by file and place there; null texts have no words, a null source is the last."""
    from .mixing import cycled, mix
    from .workspace import Workspace

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    made = mix(docs, cycled([1, 2, 3]), ["file", "row"], Workspace(spark, "mixing"))
    taken = made.spans.groupBy("k0", "k1").agg(F.sum("length").alias("taken"))
    found = made.documents.join(taken, ["k0", "k1"], "left")
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each word of six letters and five occurrences in ``documents``; null texts have none, a null id is hashed as an empty one."""
    from .spelling import variants, word_counts
    from .workspace import Workspace

    space = Workspace(spark, "spelling")
    words = space.write(word_counts(_table(spark, sf_dir, "documents"), drop=199), "words")
    return variants(words, space).select("word", "form", "root", "n", "n_near", "form_n")


WORDS_SQL = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
FOLD_SQL = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS_SQL.format(text=FOLD_SQL.format(text="text"))} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS sh FROM s),
t2 AS (SELECT doc_id, sh FROM t WHERE sh IN (SELECT sh FROM t GROUP BY sh HAVING count(*) > 1)),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t2 a JOIN t2 b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""

OP6_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, regexp_replace(text, '([\\#<])', '\\\1', 'g') AS body, regexp_replace(role, '([\\#<:])', '\\\1', 'g') AS head FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || head || ': ' || body || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP10_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format(text="text")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i,
    unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i+12], ' '))) AS win FROM w WHERE len(ws) >= 13),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win HAVING count(*) > 1),
h AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.win = f.win WHERE g.doc_id > f.first),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h),
k AS (
  SELECT p.doc_id, count(*) FILTER (c.i IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM d),
c AS (
  SELECT *, len(units) AS n, least(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS lo, greatest(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 100 THEN 'plain'
      WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle, array_to_string(units[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_source_mixing": op12_source_mixing,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL = {
    "op4_ngram_jaccard_join": OP4_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op8_sharding": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, lang, source, n_chars FROM documents",
}
