"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Every query applies its operator, with production parameters, to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, mixing, pii, quality, tiff, warc
from .common import held_out, scratch
from .gnat import hard_negatives
from .jaccard import jaccard_groups
from .repeats import remove_repeats
from .trie import conversation_trie
from .wrapper import main_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(col: Column) -> Column:
    return F.sha2(col, 256)


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = tiff.store_texts(docs).drop("text").withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", _sha(F.col("media")))
    pages = tiff.tiff_pages(stored)
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        _sha(F.col("pixels")).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(":", "compression", F.col("predictor").cast("string"), "look").alias("feature"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), out, min_bytes=0, shard_bytes=32 << 20, roll_bytes=16 << 20, level=4)
    return warc.read_warc(spark, out, with_payload=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), _sha(F.array_join("item_ids", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~held_out(F.col("doc_id")))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return quality.rate(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.sanitise(docs)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    return found.select("doc_id", *[count(k) for k in pii.KINDS], _sha(text(base)).alias("base_sha256"), text(F.col("spans")).alias("spans"), _sha(F.col("clean_text")).alias("clean_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, min_words=13).select("doc_id", "n_words", "n_removed", _sha(F.col("kept_text")).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_groups(docs, k=5, percent=80)


_TRICKY = r"\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = lambda i, role: F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"))
    extra = spark.range(1).select(F.explode(F.array(turn(0, "user"), turn(1, "assistant"))).alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(_TRICKY).alias("text"))
    read = chat.parse_formatted(chat.format_turns(chat.turns_of_rows(rows.union(extra))))
    learnt = F.array_join(F.transform(F.filter("read", lambda t: t["learn"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        _sha(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        _sha(learnt).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "selected", "raking_error")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_tiff, op2_warc, op3_decontaminate, op4_language_id, op5_quality, op6_pii, op7_substring_dedup, op8_jaccard_join, op9_chat_format, op10_mixing, op11_hard_negatives, op12_main_text, op13_conversation_trie)
}

_SAFE = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SUFFIX = len(chat.TURN) + len(chat.BODY) + len(chat.END)

ORACLE_SQL: dict[str, str] = {
    "op9_chat_format": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{_TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{_TRICKY}')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum({_SUFFIX} + length({_SAFE.format("role")}) + length({_SAFE.format("text")})) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op7_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS passage
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
        firsts AS (SELECT passage, min(doc_id) AS lo FROM win GROUP BY passage),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (passage) WHERE doc_id > lo),
        each AS (
            SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op3_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_LETTERS} AS w FROM documents), b AS (SELECT item_id, {_LETTERS} AS w FROM benchmark),
        item AS (
            SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        place AS (
            SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM item) WHERE len(w) >= k)),
        hit AS (SELECT DISTINCT doc_id, item_id, k, i FROM place JOIN item USING (k, s)),
        word AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
        names AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op8_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        l AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
        SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "op11_hard_negatives": """
        WITH e AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER w <= 5""",
    # The given pages all declare their article; SQL reads what they declare.
    "op12_main_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|$)', 1, 's') AS x FROM pages),
        t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(b|i|a|em|strong|span)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
        d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM t)
        SELECT page_id, url, text, length(text) AS n_chars FROM d""",
    "op13_conversation_trie": """
        WITH own AS (
            SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS t,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS head FROM own),
        bits AS (
            SELECT conv_id, head, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda a, x: list_reduce([xor(a, x), 1, 1, 1, 1, 1, 1, 1, 1], lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS r
            FROM c),
        h AS (SELECT conv_id, head, xor(r, 4294967295) % 9 AS h FROM bits),
        parts AS (
            SELECT h.conv_id, 0 AS part, pos, t FROM h JOIN own ON own.conv_id = head WHERE pos <= h
            UNION ALL SELECT h.conv_id, 1, pos, t FROM h JOIN own USING (conv_id) WHERE pos > h),
        seq AS (SELECT conv_id, coalesce(list(t ORDER BY part, pos) FILTER (t IS NOT NULL), []) AS s FROM h LEFT JOIN parts USING (conv_id) GROUP BY conv_id),
        member AS (SELECT conv_id, s, d, s[1:d] AS node FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
        n AS (
            SELECT node, d, min(conv_id) AS low, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends
            FROM member GROUP BY node, d),
        kids AS (SELECT node[1:d - 1] AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
        one AS (SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * octet_length(encode(node[d].x)) END AS own_saved FROM n LEFT JOIN kids USING (node)),
        up AS (SELECT node[1:k] AS node, kids, own_saved FROM (SELECT node, kids, own_saved, unnest(range(0, d + 1)) AS k FROM one)),
        total AS (SELECT node, count(*) FILTER (kids = 0) AS leaves, sum(own_saved) AS saved FROM up GROUP BY node)
        SELECT one.low AS conv_id, one.d AS depth, parent.low AS parent_conv_id, one.n AS n_convs, one.kids AS n_children, leaves AS n_leaves,
            CAST(saved AS BIGINT) AS saved_tokens, one.ends AS ends_sha256
        FROM one JOIN total USING (node) LEFT JOIN n AS parent ON one.d > 0 AND parent.node = one.node[1:one.d - 1]""",
}
