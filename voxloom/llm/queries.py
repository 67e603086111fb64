"""The numbered queries over the shared test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm.exact_dedup import exact_duplicates
from voxloom.llm.html_extraction import extract_main_text
from voxloom.llm.language_id import identify_languages
from voxloom.llm.ngram_join import ngram_components
from voxloom.llm.packing import pack
from voxloom.llm.piece_lattice import segment_nbest
from voxloom.llm.sentence_dedup import remove_repeated_spans
from voxloom.llm.sharding import assign_shards
from voxloom.llm.tool_calls import REPLY_SCHEMA, conversation_calls, link_tool_calls
from voxloom.llm.transport_stream import describe_media, store_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; the files stay where the installation has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=1024)


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_tool_calls(*conversation_calls(_table(spark, sf_dir, "conversations")), REPLY_SCHEMA)
    return found.withColumnRenamed("conv", "conv_id")


def op4_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_nbest(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), n=4)


def op5_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(store_texts(_table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), [1.0] * 8)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_style_tree": op1_site_style_tree,
    "op2_mixture_packing": op2_mixture_packing,
    "op3_tool_call_linking": op3_tool_call_linking,
    "op4_piece_nbest": op4_piece_nbest,
    "op5_sentence_span_dedup": op5_sentence_span_dedup,
    "op6_transport_streams": op6_transport_streams,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_rendezvous_shards": op8_rendezvous_shards,
    "op9_language_id": op9_language_id,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    # for pages whose article has paragraphs and headings only, as those of the test tables
    "op1_site_style_tree": r"""
        WITH b AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>') AS blocks FROM pages),
             c AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(
                       regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM b)
        SELECT page_id, url, coalesce(list_aggregate(list_filter(blocks, lambda x: x <> ''), 'string_agg', chr(10)), '') AS text,
               length(coalesce(list_aggregate(list_filter(blocks, lambda x: x <> ''), 'string_agg', chr(10)), '')) AS n_chars FROM c""",
    "op3_tool_call_linking": """
        WITH u AS (SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, text FROM conversations WHERE role = 'user'),
             a AS (SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
             j AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.call_id, a.call_id) AS call_id, u.turn AS position,
                          a.turn AS result_position, coalesce(u.turn, a.turn) AS level, u.text AS prompt, a.text AS content,
                          CASE WHEN u.turn IS NULL THEN 'orphan' WHEN a.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
                          CASE WHEN u.text = '' THEN ['prompt: minLength'] ELSE [] :: VARCHAR[] END AS errors
                   FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.call_id = a.call_id)
        SELECT conv_id, call_id, position, result_position, level, status, errors,
               '{"arguments":' || CASE WHEN position IS NULL THEN 'null' ELSE '{"prompt":' || to_json(prompt) || ',"turn":' || position || '}' END
               || ',"call_id":' || to_json(call_id) || ',"errors":' || to_json(errors) || ',"level":' || level
               || ',"name":' || CASE WHEN position IS NULL THEN 'null' ELSE '"reply"' END
               || ',"result":' || coalesce(to_json(content), 'null') || ',"status":' || to_json(status) || '}' AS json
        FROM j""",
    "op5_sentence_span_dedup": r"""
        WITH t AS (SELECT doc_id, text, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*') AS lead,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS tokens FROM documents),
             v AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i, len(tokens) AS n FROM t),
             w AS (SELECT doc_id, i, n, token, translate(regexp_extract(token, '^[^\x20\x09-\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM v),
             k AS (SELECT *, CASE WHEN regexp_matches(word, '[.!?]["'')\]]?$') THEN '' ELSE substr(md5(word), 1, 16) END AS key FROM w),
             m AS (SELECT *, CASE WHEN i <= n - 8 THEN min(key) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) END AS least FROM k),
             o AS (SELECT *, key = '' OR coalesce(max(least) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) = key, false) AS ends FROM m),
             p AS (SELECT *, i = 1 OR lag(ends) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM o),
             r AS (SELECT *, sum(head :: INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM p),
             u AS (SELECT doc_id, unit, min(i) AS a, max(i) AS b, string_agg(token, '' ORDER BY i) AS raw FROM r GROUP BY 1, 2),
             words AS (SELECT doc_id, list(word ORDER BY i) AS words FROM w GROUP BY 1),
             spans AS (SELECT x.doc_id, x.unit AS first, y.unit AS last, x.a AS a, y.b AS b,
                              row_number() OVER (PARTITION BY x.doc_id, x.unit ORDER BY y.unit) AS ahead
                       FROM u x JOIN u y ON x.doc_id = y.doc_id AND y.unit BETWEEN x.unit + 2 AND x.unit + 31 AND y.b - x.a >= 23),
             runs AS (SELECT s.doc_id, first, last, md5(list_aggregate(words[a : b], 'string_agg', ' ')) AS run FROM spans s JOIN words USING (doc_id) WHERE ahead = 1),
             homes AS (SELECT run, min(struct_pack(d := doc_id, f := first)) AS home FROM runs GROUP BY 1 HAVING count(*) > 1),
             again AS (SELECT doc_id, first, last FROM runs JOIN homes USING (run) WHERE struct_pack(d := doc_id, f := first) <> home),
             gone AS (SELECT DISTINCT u.doc_id, u.unit FROM u JOIN again g ON g.doc_id = u.doc_id AND u.unit BETWEEN g.first AND g.last),
             kept AS (SELECT u.doc_id, string_agg(raw, '' ORDER BY u.unit) FILTER (g.unit IS NULL) AS body, count(g.unit) AS n_removed FROM u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.unit = u.unit GROUP BY 1)
        SELECT t.doc_id, CASE WHEN n_removed > 0 THEN regexp_replace(lead || coalesce(body, ''), '[\x20\x09-\x0D]+$', '') ELSE text END AS text, coalesce(n_removed, 0) AS n_removed
        FROM t LEFT JOIN kept USING (doc_id)""",
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_ASCII}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)""",
    "op10_ngram_jaccard_join": f"""
        WITH RECURSIVE
          w AS (SELECT doc_id, list_filter(string_split_regex({_ASCII}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
          s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
                       ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i : i + 4], 'string_agg', ' ')) END) AS s FROM w),
          n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
          p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
          l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
          e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
          r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
        FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1""",
}
