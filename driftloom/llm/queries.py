"""The registered queries of the llm operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import bpe, chat, divergence, linededup, minhash, packing, pqdedup, tokencount, topk, toxicity, trie, urlfilter, wavelet
from driftloom.plans.lineage import cut, discard, shared_folder
from driftloom.sources.tables import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all ``embeddings`` by integer inner product, for every row with an id divisible by 50."""
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), 256)
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` by 4-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of ``documents`` there and back; digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded_col="decoded")
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of ``documents`` over the pieces and scores of a public model file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


#: The rules of the op4 contract.
URL_RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of ``pages``."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumn("score", F.round("score", 6))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``embeddings`` at cosine 0.9."""
    return pqdedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of ``documents``, learnt from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` tokenized and packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` and one of control strings formatted; digests of what is read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    back = chat.read_back(chat.format_conversations(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of ``documents``; digests of what stays."""
    out = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of ``conversations`` of which each opens with up to 8 turns of the first of its five."""
    turns = trie.ordered_turns(table(spark, sf_dir, "conversations"))
    base, taken = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return trie.prefix_trie(*trie.with_openings(turns, base, taken, 8))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of ``documents`` against the others of its language and, by terms, against the whole language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written as shards of wavelet matrices and read back; the shards go once they have been read."""
    folder = shared_folder(spark)
    wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    back = cut(wavelet.documents(spark, folder))
    discard(spark, folder)
    return back


QUERIES = {
    "op1_topk": op1_topk,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_chat_format": op8_chat_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_count": op10_token_count,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_output": op13_token_output,
    "pipeline": corpus_pipeline.run,
}

def _url_sql() -> str:
    """The rules and both models of op4 in SQL, order by order."""
    rules = sorted(URL_RULES, key=lambda r: (-len(str(r)), str(r)))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in rules) + " END"
    k_max = urlfilter.ORDER
    mix = lambda c: f"CASE WHEN all_{c} > 0 THEN (n_{c} + kinds_{c} * p_{c}) / (all_{c} + kinds_{c}) ELSE p_{c} END AS p_{c}"
    steps = ["f0 AS (SELECT \"window\", 1e0 / 256 AS p_allow, 1e0 / 256 AS p_block FROM cnt)"]
    for k in range(k_max + 1):
        steps.append(
            f"f{k + 1} AS (SELECT f.\"window\", {mix('allow')}, {mix('block')} FROM f{k} AS f JOIN part USING (\"window\") JOIN gram USING (k, context, next) JOIN ctx USING (k, context) WHERE k = {k})"
        )
    stat = lambda c, held: f"(SELECT sum(n * score) / sum(n) AS m, sqrt(greatest(sum(n * score * score) / sum(n) - pow(sum(n * score) / sum(n), 2), 1e-12)) AS d FROM texts JOIN scored USING (text) WHERE label = '{c}' AND {held})"
    bar = lambda held: f"(SELECT (a.m * b.d + b.m * a.d) / (a.d + b.d) AS t FROM {stat('allow', held)} AS a, {stat('block', held)} AS b)"
    return rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
ruled AS (SELECT *, host || path AS text, {case(str)} AS rule, {case(lambda r: r.verdict)} AS label FROM parts),
texts AS (SELECT text, max(label) AS label, count(*) AS n, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) % {urlfilter.FOLDS} = 0 AS held FROM ruled GROUP BY text),
win AS (SELECT text, CASE WHEN NOT held THEN label END AS label, n, substr(repeat(chr(2), {k_max}) || text || chr(3), unnest(generate_series(1, length(text) + 1)), {k_max + 1}) AS "window" FROM texts),
cnt AS (SELECT "window", coalesce(sum(n) FILTER (WHERE label = 'allow'), 0) AS allow, coalesce(sum(n) FILTER (WHERE label = 'block'), 0) AS block FROM win GROUP BY ALL),
part AS (SELECT "window", allow, block, k, substr("window", {k_max + 1} - k, k) AS context, substr("window", {k_max + 1}, 1) AS next FROM cnt, range({k_max + 1}) AS r(k)),
gram AS (SELECT k, context, next, sum(allow) AS n_allow, sum(block) AS n_block FROM part GROUP BY ALL),
ctx AS (SELECT k, context, sum(n_allow) AS all_allow, sum(n_block) AS all_block, count(*) FILTER (WHERE n_allow > 0) AS kinds_allow, count(*) FILTER (WHERE n_block > 0) AS kinds_block FROM gram GROUP BY ALL),
{", ".join(steps)},
one AS (SELECT DISTINCT text FROM texts),
scored AS (
  SELECT text, avg(ln(p_allow) - ln(p_block)) AS score
  FROM (SELECT text, substr(repeat(chr(2), {k_max}) || text || chr(3), unnest(generate_series(1, length(text) + 1)), {k_max + 1}) AS "window" FROM one) JOIN f{k_max + 1} USING ("window") GROUP BY text),
bar AS (SELECT coalesce((SELECT t FROM {bar("held")}), (SELECT t FROM {bar("true")}), 0) AS t)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= (SELECT t FROM bar) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM ruled JOIN scored USING (text)
"""


#: Links as pairs (a, b), a < b, to the smallest id that each id reaches.
_REACH_SQL = """
reach AS (SELECT id, id AS to_id FROM ids UNION SELECT r.id, CASE WHEN l.a = r.to_id THEN l.b ELSE l.a END FROM reach r JOIN links l ON r.to_id IN (l.a, l.b)),
components AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)"""

ORACLE_SQL = {
    "op2_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sets),
x AS (SELECT doc_id, unnest(s) AS s FROM sets),
links AS (
  SELECT p.a, p.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS i FROM x AS l JOIN x AS r ON l.s = r.s AND l.doc_id < r.doc_id GROUP BY ALL) AS p
  JOIN n AS na ON na.doc_id = p.a JOIN n AS nb ON nb.doc_id = p.b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
ids AS (SELECT doc_id AS id FROM documents), {_REACH_SQL}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN components ON id = doc_id
""",
    "op4_url_filter": _url_sql(),
    "op5_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v AS l JOIN v AS r ON l.vec_id < r.vec_id WHERE list_cosine_similarity(l.v, r.v) >= 0.9),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACH_SQL}
SELECT vec_id, (SELECT count(*) FROM links WHERE vec_id IN (a, b)) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN components ON id = vec_id
""",
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""",
    "op8_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<ROLE>>|<</ROLE>>')) AS n,
             len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<ROLE>>|<</ROLE>>')) AS m FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + n + CASE role WHEN 'user' THEN 19 WHEN 'assistant' THEN 5 ELSE 22 + length(role) + m END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (  -- CRC-32 of the decimal id, bit by bit
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(s)), lambda i: ord(s[i + 1])::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
r AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS k, strlen(text) AS b FROM (
    SELECT crc.c, 0 AS own, p, role, text FROM crc JOIN t ON t.c = crc.c - crc.c % 5 AND p <= h
    UNION ALL SELECT crc.c, 1, p, role, text FROM crc JOIN t ON t.c = crc.c AND p > h)),
x AS (SELECT c, d, b, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS pre FROM r UNION ALL SELECT c, 0, 0, '' FROM crc),
n AS (SELECT d, pre, min(c) AS conv, count(*) AS n_convs, any_value(b) AS b FROM x GROUP BY ALL),
m AS (SELECT x.c, d, n.conv FROM x JOIN n USING (d, pre)),
parent AS (SELECT n.d, n.conv, m.conv AS parent FROM n JOIN m ON m.c = n.conv AND m.d = n.d - 1),
kids AS (SELECT d - 1 AS d, parent AS conv, count(*) AS n_children FROM parent GROUP BY ALL),
sums AS (
  SELECT up.d, up.conv, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens
  FROM n LEFT JOIN kids USING (d, conv) JOIN m AS up ON up.c = n.conv AND up.d <= n.d GROUP BY ALL),
ends AS (SELECT d, conv, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM m JOIN (SELECT c, max(d) AS d FROM x GROUP BY c) USING (c, d) GROUP BY ALL)
SELECT n.conv AS conv_id, CAST(n.d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sums USING (d, conv) LEFT JOIN parent USING (d, conv) LEFT JOIN kids USING (d, conv) LEFT JOIN ends USING (d, conv)
""",
    "op12_source_divergence": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM t),
kept AS (SELECT lang, term, count(*) AS lang_n FROM x GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM t) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v)::HUGEINT AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= 200
""",
}
