"""The queries of the corpus operators, with their production parameters, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, exact, fingerprint, html, ngram, packing, quality, repair, substring, suffix, warc
from .common import scratch, table

VOCABULARY = "byte_bpe_50k.json"
#: The conversation whose texts look like the template (fixed value).
HARD_TURN = "\\### Assistant: </turn> ok"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents")).drop("spans")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TURN), (-7, 1, "assistant", HARD_TURN)], "conv_id long, turn long, role string, text string")
    found = chat.format_conversations(rows.unionByName(hard))
    return found.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.link(table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary()).drop("ids", "decoded")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = quality.score(docs, model)
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.mark(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.as_text(F.col("text_sketch")).alias("fingerprint"), fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("text_sketch"), F.col("edited_sketch")).alias("near_edited"), fingerprint.likeness(F.col("text_sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(repair.damage(table(spark, sf_dir, "conversations")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing, "op2_suffix": op2_suffix, "op3_html": op3_html, "op4_chat": op4_chat, "op5_ngram": op5_ngram, "op6_warc": op6_warc, "op7_bpe": op7_bpe,
        "op8_quality": op8_quality, "op9_exact": op9_exact, "op10_fingerprint": op10_fingerprint, "op11_audit": op11_audit, "op12_repair": op12_repair, "op13_substring": op13_substring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact": """
            WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY text_sha256)""",
        "op11_audit": """
            WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
            w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
            l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
            f AS (
                SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
                       100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                       coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e
                FROM w LEFT JOIN l USING (doc_id)),
            m AS (SELECT part, good, toxic, [x for x in ['A', 'B', 'C', 'D', 'E'] if [a, b, c, d, e][ascii(x) - 64]] AS fails, count(*) AS n FROM f GROUP BY ALL),
            x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
            o AS (SELECT i.x || j.x || k.x || p.x || q.x AS filter_order FROM x i, x j, x k, x p, x q WHERE len(list_distinct([i.x, j.x, k.x, p.x, q.x])) = 5),
            s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS own, string_split(substr(filter_order, 1, step::INT - 1), '') AS before FROM o, range(1, 6) t(step)),
            g AS (
                SELECT part, filter_order, step, own, sum(n) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, own)) AS kept,
                       sum(n) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, own)) AS removed, sum(n) FILTER (list_has_any(fails, before) AND list_contains(fails, own)) AS redundant,
                       sum(n) FILTER (fails = [own]) AS unique_fails, sum(n) FILTER (good AND NOT list_has_any(fails, before) AND list_contains(fails, own)) AS good_lost,
                       sum(n) FILTER (toxic AND NOT list_has_any(fails, before) AND list_contains(fails, own)) AS toxic_lost
                FROM m, s GROUP BY ALL)
            SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
                   coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
                   coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
            FROM g""",
        "op12_repair": """
            WITH RECURSIVE k AS (
                SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
            c AS (
                SELECT * EXCLUDE (key), xor(list_reduce([ascii(x)::BIGINT for x in string_split(key, '')],
                    lambda crc, byte: list_reduce(range(8), lambda r, i: xor(r // 2, (r % 2) * 3988292384), xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fault
                FROM k),
            r AS (
                SELECT conv_id, turn, copy, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                       CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                FROM c, (VALUES (0), (1)) v(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
            n AS (
                SELECT *, row_number() OVER o AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(role[1]) OVER o AS before
                FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
            f AS (
                SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault,
                       before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal
                FROM n),
            moves AS (FROM (VALUES ('0', 's', '1'), ('0', 'u', '2'), ('1', 'u', '2'), ('3', 'u', '2'), ('2', 'a', '3')) v(a, letter, b)),
            gaps AS (
                FROM (VALUES ('0', '0', 0, '', ''), ('1', '1', 0, '', ''), ('2', '2', 0, '', ''), ('3', '3', 0, '', ''), ('0', '2', 5, 'I', 'user:'), ('1', '2', 5, 'I', 'user:'), ('3', '2', 5, 'I', 'user:'),
                    ('2', '3', 5, 'I', 'assistant:'), ('0', '3', 10, 'II', 'user:' || chr(10) || 'assistant:'), ('1', '3', 10, 'II', 'user:' || chr(10) || 'assistant:')) v(a, b, cost, letters, added)),
            conv AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
            own AS (SELECT c, f.* FROM f JOIN conv ON f.conv_id IS NOT DISTINCT FROM conv.conv_id),
            walk AS (
                SELECT c, 0::BIGINT AS pos, '0' AS state, 0::BIGINT AS cost, '' AS audit, '' AS done FROM conv
                UNION ALL
                SELECT c, pos, state, best.cost, best.audit, best.done FROM (
                    SELECT w.c, e.pos, e.state, min({'cost': w.cost + g.cost + e.cost, 'audit': w.audit || g.letters || e.letter, 'done': concat_ws(chr(10), nullif(w.done, ''), nullif(g.added, ''), nullif(e.line, ''))}) AS best
                    FROM walk w JOIN gaps g ON w.state = g.a JOIN (
                        SELECT c, pos, a, a AS state, 2 AS cost, 'D' AS letter, '' AS line FROM own, (VALUES ('0'), ('1'), ('2'), ('3')) v(a)
                        UNION ALL SELECT c, pos, a, b, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K', role || ':' || text FROM own JOIN moves ON role[1] = letter WHERE fault NOT IN ('b', 'd')
                        UNION ALL SELECT c, pos, a, b, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R', CASE letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text FROM own JOIN moves ON letter IN ('u', 'a') WHERE fault NOT IN ('b', 'd')
                    ) e ON e.c = w.c AND e.pos = w.pos + 1 AND e.a = g.b
                    GROUP BY w.c, e.pos, e.state)),
            last AS (SELECT c, max(pos) AS pos FROM walk GROUP BY c),
            best AS (
                SELECT c, min({'cost': w.cost + g.cost, 'audit': w.audit || g.letters, 'done': concat_ws(chr(10), nullif(w.done, ''), nullif(g.added, ''))}) AS best
                FROM walk w JOIN last USING (c, pos) JOIN gaps g ON w.state = g.a AND g.b IN ('0', '3') GROUP BY c),
            counts AS (
                SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                       count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
                FROM own GROUP BY c)
            SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
                   best.cost AS cost, best.audit AS audit, sha256(best.done) AS repaired_sha256
            FROM conv JOIN best USING (c) LEFT JOIN counts USING (c)""",
        "op13_substring": """
            WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
            p AS (SELECT doc_id, words, unnest(range(len(words))) AS pos FROM w),
            k AS (SELECT doc_id, pos, words[pos + 1] AS word, CASE WHEN pos + 20 <= len(words) THEN array_to_string(words[pos + 1 : pos + 20], ' ') END AS key FROM p),
            f AS (SELECT doc_id, pos, word, key IS NOT NULL AND min({'d': doc_id, 'a': pos}) OVER (PARTITION BY key) < {'d': doc_id, 'a': pos} AS again FROM k),
            g AS (SELECT doc_id, pos, word, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
            s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
            SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)""",
    }
