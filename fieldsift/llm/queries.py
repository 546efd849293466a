"""The registered queries of the corpus operators: thin views of what each operator returns, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search, valid_vectors

    rows = valid_vectors(read(spark, sf_dir, "embeddings"))
    return search(rows.where("vec_id % 50 = 0"), rows, k=5)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), limit=4096)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import kept_bytes, repeated_spans

    return kept_bytes(repeated_spans(read(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import decode_documents, encode_documents

    out = decode_documents(encode_documents(read(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


#: The rules of the registered query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(read(spark, sf_dir, "pages"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest_chats, format_chats

    said = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest_chats(format_chats(turns.union(added)), in_order=True)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie, sequences, share_openings

    return prefix_trie(share_openings(sequences(read(spark, sf_dir, "conversations"))))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann_search, op2_token_counts, op3_suffix_dedup, op4_byte_bpe, op5_quality_rules, op6_minhash_dedup, op7_url_filter, op8_toxicity, op9_packing, op10_html_text,
        op11_chat_format, op12_prefix_trie, op13_spelling_variants,
    )
}

#: The unsigned crc32 of the bytes whose upper-case hex digits are in the column h, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(0, length(h)//2), lambda i: [('0x' || substr(h, 2*i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)))"""

ORACLES: dict[str, str] = {
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, unhex(substr(h, 2*i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h)//2 - 49, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s AND f.first < w.doc_id),
run AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, k),
piece AS (SELECT span.doc_id, a, b, substr(h, 2*coalesce(lag(b) OVER o, 0) + 1, 2*(a - coalesce(lag(b) OVER o, 0))) AS t FROM span JOIN d USING (doc_id) WINDOW o AS (PARTITION BY span.doc_id ORDER BY a)),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(t, '' ORDER BY a) AS t FROM piece GROUP BY doc_id)
SELECT d.doc_id, length(h)//2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(coalesce(t, '') || substr(h, 2*coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)""",
    "op6_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
e AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL) p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100*c >= 85*(na.n + nb.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b.y, r.c FROM r JOIN both_ways b ON b.x = r.doc_id WHERE r.c < b.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op11_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
e AS (SELECT *, length(text) AS n,
(length(text) - length(replace(text, '<|im_start|>', ''))) // 12 + (length(text) - length(replace(text, '<|im_end|>', ''))) // 10 + (length(text) - length(replace(text, '<\', ''))) // 2 AS more FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(24 + length(role) + n + more) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op12_prefix_trie": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
q AS (SELECT conv_id, list(struct_pack(k := k, w := len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) ORDER BY turn NULLS FIRST, k) AS s FROM t GROUP BY conv_id),
h AS (SELECT *, {_CRC32} % 4 AS n FROM (SELECT *, hex(encode(CAST(conv_id AS VARCHAR))) AS h FROM q)),
b AS (SELECT h.conv_id, list_concat(coalesce(base.s[1:n], []), h.s[n + 1:]) AS s FROM h LEFT JOIN q base ON base.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(s) AS n, d, array_to_string(list_transform(s[1:d], lambda z: z.k), '') AS key, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM b)),
node AS (SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY key, d),
kid AS (SELECT substr(key, 1, 64 * (depth - 1)) AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
v AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid USING (key)),
below AS (SELECT substr(key, 1, 64 * a) AS key, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN below USING (key) LEFT JOIN node up ON v.depth > 0 AND up.key = substr(v.key, 1, 64 * (v.depth - 1))""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM r WHERE length(w) >= 6 GROUP BY doc_id, w),
c AS (SELECT w, n, {_CRC32} AS h FROM g),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM c) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gap AS MATERIALIZED (SELECT word, n, unnest(range(0, length(word))) AS i FROM v),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM gap),
pair AS MATERIALIZED (SELECT DISTINCT * FROM (
SELECT a.word AS x, a.n AS xn, b.word AS y, b.n AS yn FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
UNION ALL SELECT a.word, a.n, v.word, v.n FROM cut a JOIN v ON v.word = a.rest
UNION ALL SELECT v.word, v.n, a.word, a.n FROM cut a JOIN v ON v.word = a.rest)),
best AS (SELECT x, xn, count(*) AS n_near, first(y ORDER BY yn DESC, y) AS form, max(yn) AS form_n FROM pair GROUP BY x, xn),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN best ON x = word),
walk AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.onward)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.onward IS NULL""",
}
