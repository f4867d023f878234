"""Queries pN_... on text corpora, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from meterlark.llm import credentials as p1, encode as p7, leaks as p8, neardup as p5, pairs as p4, personal as p3, split as p9, tickets as p6
from meterlark.session import table


def p1_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.credentials(table(spark, sf_dir, "config_file"), "file_id", "body")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_credentials(spark, sf_dir).select("file_id", "line_no").distinct()


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.masked(table(spark, sf_dir, "config_file"), "file_id", "body")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, text) of help-desk messages and log remarks."""
    messages = table(spark, sf_dir, "support_message").select(F.lit("support_message").alias("src"), F.col("message_id").alias("row_id"), F.col("body").alias("text"))
    return messages.unionByName(table(spark, sf_dir, "usage_log").select(F.lit("usage_log").alias("src"), F.col("id").alias("row_id"), F.col("content").alias("text")))


def p3_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.personal(_texts(spark, sf_dir), ["src", "row_id"], "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.kinds(p3_details(spark, sf_dir), ["src", "row_id"])


def p3_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.placeholders(_texts(spark, sf_dir), ["src", "row_id"], "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.defects(table(spark, sf_dir, "help_pair"), "pair_id", "question", "answer")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.similar(table(spark, sf_dir, "incident_note"), "note_id", "body")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note's class of equal word sets and the number of classes it is linked to."""
    return p5.classes(table(spark, sf_dir, "incident_note"), "note_id", "body").withColumnRenamed("class", "class_id")


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.class_links(table(spark, sf_dir, "incident_note"), "note_id", "body")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of notes that are nearly the same: connected by links, whatever their number."""
    return p5.groups(table(spark, sf_dir, "incident_note"), "note_id", "body").withColumnRenamed("group", "group_id")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.turns(table(spark, sf_dir, "support_message"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_turns(spark, sf_dir).select("ticket_id", "turn_no", "message_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7.encode(table(spark, sf_dir, "documents"), "doc_id", "text", p7.vocabulary())


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: five in six of twelve words within eighteen places, in any order."""
    return p8.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text", near=(5 / 6, 18))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", p7.vocabulary())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = p9.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", p7.vocabulary(), with_text=False)
    return cut.filter("piece_no = 1").select("doc_id")


# Brute force over all pairs of notes that share a word.
_NOTES = """WITH RECURSIVE w AS (SELECT DISTINCT note_id, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM incident_note),
    n AS (SELECT note_id, count(*) AS n, min(note_id) OVER (PARTITION BY list_sort(list(w))) AS class_id FROM w GROUP BY note_id HAVING count(*) >= 8),
    pairs AS (SELECT a, b, x.class_id AS class_a, y.class_id AS class_b FROM (SELECT x.note_id AS a, y.note_id AS b, count(*) AS shared FROM w x JOIN w y ON x.w = y.w AND x.note_id < y.note_id GROUP BY 1, 2) JOIN n x ON x.note_id = a JOIN n y ON y.note_id = b WHERE shared >= 0.7 * (x.n + y.n - shared)),
    links AS (SELECT DISTINCT least(class_a, class_b) AS class_a, greatest(class_a, class_b) AS class_b FROM pairs WHERE class_a <> class_b),
    ends AS (SELECT class_a AS x, class_b AS y FROM links UNION ALL SELECT class_b, class_a FROM links),
    reach(x, y) AS (SELECT class_id, class_id FROM n UNION SELECT reach.x, ends.y FROM reach JOIN ends ON ends.x = reach.y)
"""
_WORDS = "regexp_extract_all(replace(replace(lower(text), 'i̇', 'i'), 'ς', 'σ'), '[\\pL\\pN]+')"


def _grams(table: str, key: str) -> str:
    """Every run of twelve words of every text."""
    return f"SELECT DISTINCT {key}, unnest([hash(w[k : k + 11]) FOR k IN range(1, len(w) - 10)]) AS g FROM (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12"


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_ROLE = "CASE " + " ".join(f"WHEN word IN ({_in(p6.readings(name))}) THEN '{name}'" for name in p6.ROLES) + " END"
_TURNS = f"""WITH RECURSIVE r AS (SELECT *, min(message_id) OVER (PARTITION BY ticket_id, author_role, body, sent_at, reply_to) AS first, regexp_replace(regexp_replace(lower(author_role), '^[\\s\\pZ]+', ''), '[\\s\\pZ.]+$', '') AS word FROM support_message WHERE ticket_id IS NOT NULL AND message_id IS NOT NULL),
    ids AS (SELECT DISTINCT ticket_id, message_id AS reply_to, first AS parent, sent_at AS parent_at FROM r),
    m AS (SELECT DISTINCT r.ticket_id, r.message_id, r.sent_at, r.reply_to, {_ROLE} AS role, r.body IS NULL OR regexp_full_match(r.body, '[\\s\\pZ]*') AS blank, ids.parent, ids.parent_at FROM r LEFT JOIN ids ON r.ticket_id = ids.ticket_id AND r.reply_to = ids.reply_to WHERE r.message_id = r.first),
    l AS (SELECT message_id, 0 AS layer FROM m WHERE parent IS NULL OR parent_at IS DISTINCT FROM sent_at UNION ALL SELECT m.message_id, l.layer + 1 FROM l JOIN m ON m.parent = l.message_id AND m.parent_at = m.sent_at),
    whole AS (SELECT message_id FROM m WHERE parent IS NULL UNION ALL SELECT m.message_id FROM whole JOIN m ON m.parent = whole.message_id),
    placed AS (SELECT m.*, l.layer, m.sent_at IS NULL OR role IS NULL OR (m.reply_to IS NOT NULL AND parent IS NULL) OR m.message_id NOT IN (SELECT message_id FROM whole) AS broken FROM m LEFT JOIN l ON m.message_id = l.message_id),
    kept AS (SELECT ticket_id FROM placed GROUP BY ticket_id HAVING NOT bool_or(broken) AND arg_min(role, (sent_at, layer, message_id)) FILTER (NOT blank AND role <> 'system') = 'customer' AND arg_max(role, (sent_at, layer, message_id)) FILTER (NOT blank AND role <> 'system') = 'agent'),
    turns AS (SELECT ticket_id, (row_number() OVER w)::INTEGER AS turn_no, message_id, role, last_value(CASE WHEN role <> 'system' THEN role END IGNORE NULLS) OVER (PARTITION BY ticket_id ORDER BY sent_at, layer, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spoke FROM placed WHERE NOT blank AND ticket_id IN (SELECT ticket_id FROM kept) WINDOW w AS (PARTITION BY ticket_id ORDER BY sent_at, layer, message_id))
"""
SQL: dict[str, str] = {
    "p6_found": _TURNS + "SELECT ticket_id, turn_no, message_id FROM turns",
    "p6_turns": _TURNS + "SELECT ticket_id, turn_no, message_id, role, coalesce(role <> 'system' AND role = spoke, false) AS repeats FROM turns",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) d JOIN ({_grams('eval_item', 'item_id')}) i ON d.g = i.g",
    "p5_found": _NOTES + "SELECT a AS note_id_a, b AS note_id_b FROM pairs",
    "p5_classes": _NOTES + "SELECT note_id, class_id, (SELECT count(*) FROM ends WHERE ends.x = n.class_id) AS links FROM n",
    "p5_links": _NOTES + "SELECT class_a, class_b FROM links",
    "p5_groups": _NOTES + "SELECT note_id, (SELECT min(y) FROM reach WHERE reach.x = n.class_id) AS group_id FROM n",
}
QUERIES = {f.__name__: f for f in (p1_found, p1_credentials, p1_masked, p3_found, p3_details, p3_replaced, p4_found, p5_found, p5_classes, p5_links, p5_groups, p6_found, p6_turns, p7_ids, p8_found, p8_leaks, p8_near, p9_found, p9_pieces)}
