"""Line dedup by a log-template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import discard, row_key, stored, with_lookup

#: Tenths of a line's tokens, rounded up, that lead to its leaf, and that at least stay in its template.
LEADING, STAYING = 3, 7
#: Documents in which a template must occur to be dropped; copies of a document count as one.
MIN_DOCS = 3
#: Share of a document's characters in recurring lines up to which it is a text of its own, and from which a near copy of others.
OWN = 0.5
NEAR_COPY = 0.8
#: A document with fewer recurring lines is a text of its own, however long they are.
COPIED_LINES = 3
#: A token with a digit, a link or an address is a variable field wherever it stands.
_VARIABLE = r"(?<!\S)(?:[^\s\d]*+\d\S*+|https?://\S*+|[^\s@]++@\S++)"


def _masked(line: Column) -> Column:
    """A line with its variable tokens as <*> and single spaces. Most lines have nothing to rewrite, which one scan tells."""
    rewritten = F.regexp_replace(F.regexp_replace(line, _VARIABLE, "<*>"), r"\s+", " ")
    return F.trim(F.when(F.regexp_like(line, F.lit(r"[\d@\t\r\f]|://|  ")), rewritten).otherwise(line))


def _tokens(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')) + 1)"


def _tenths(n: str, k: int) -> str:
    return f"CAST(({k} * {n} + 9) DIV 10 AS INT)"


def _lines(docs: DataFrame) -> DataFrame:
    """(key, copy, total, leaf, masked) of each document row: its key, the hash of its masked lines, which copies share, their characters, and the leaf and the masked text of each line, side by side; blank lines have leaf 0.

    A leaf is the hash of a line's number of tokens and its leading tokens: the path through a tree of fixed depth.
    """
    d = docs.select(row_key().alias("key"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), _masked).alias("masked"))
    leaf = f"transform(masked, x -> IF(x = '', 0L, xxhash64({_tokens('x')}, substring_index(x, ' ', {_tenths(_tokens('x'), LEADING)}))))"
    return d.select("key", F.expr("xxhash64(filter(masked, x -> x != ''))").alias("copy"), F.length(F.array_join("masked", "")).alias("total"), F.expr(leaf).alias("leaf"), "masked")


def line_templates(lines: DataFrame) -> DataFrame:
    """(leaf, line, template) of distinct lines (leaf, line: the hash of masked, masked).

    The lines of a leaf are compared place by place: in how many of its lines does each token stand there. A line's template
    keeps the tokens that stand in at least as many as its STAYING-tenths most frequent one; the others, the rarest, are
    variable fields. A line that is alone in its leaf is its own template. Counts are combined map-side and joined, so a
    leaf is never gathered; only the tokens of one line meet.
    """
    crowded = lines.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select("leaf")
    several = lines.join(crowded, "leaf", "left_semi")
    each = stored(several.select("leaf", "line", F.posexplode(F.transform(F.split("masked", " "), lambda t: F.xxhash64(t))).alias("place", "token")), "tokens")
    often = each.groupBy("leaf", "place", "token").agg(F.count("*").alias("n"))
    counted = each.join(often, ["leaf", "place", "token"]).groupBy("leaf", "line").agg(F.array_sort(F.collect_list(F.struct("place", "token", "n"))).alias("t"))
    least = F.expr(f"array_sort(t.n)[size(t) - {_tenths('size(t)', STAYING)}]")
    counted = counted.withColumn("least", least)
    general = counted.select("leaf", "line", F.expr("xxhash64(leaf, transform(t, x -> IF(x.n >= least, x.token, 0L)))").alias("template"))
    alone = lines.select("leaf", "line").join(crowded, "leaf", "left_anti").select("leaf", "line", F.xxhash64("leaf", "line").alias("template"))
    return general.unionByName(alone)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, places): of each document with recurring lines its key and the lines' places from 0."""
    arrays = stored(_lines(docs), "lines")
    narrow = arrays.select("key", F.posexplode("leaf").alias("at", "leaf")).filter("leaf != 0")
    # most leaves have one line only; they are out after one count with map-side combination
    leaves = stored(narrow.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "leaves")
    whole = arrays.select("key", "copy", "total", F.posexplode(F.arrays_zip("leaf", "masked")).alias("at", "z")).select("key", "copy", "total", "at", "z.*").filter("leaf != 0")
    each = whole.join(leaves, "leaf", "left_semi").withColumn("line", F.xxhash64("masked"))
    each = stored(each.select("key", "copy", "total", "at", "leaf", "line", F.length("masked").alias("size"), "masked"), "candidates")
    lines = stored(each.groupBy("leaf", "line").agg(F.min("masked").alias("masked")), "distinct")
    templates = stored(line_templates(lines), "templates")
    # what is joined is a table before, so that a very common line's rows can be split over tasks
    each = stored(each.drop("masked").join(templates, ["leaf", "line"]).select("key", "copy", "total", "at", "size", "template"), "each")
    n = each.select("template", "copy").distinct().groupBy("template").agg(F.count("*").alias("n"))
    recurring = stored(n.filter(F.col("n") >= min_docs).select("template"), "recurring")
    each = stored(each.join(recurring, "template", "left_semi"), "recurring_lines")
    discard(arrays)
    shared = each.select("key", "total", "at", "size").distinct().groupBy("key", "total").agg(F.when(F.count("*") >= COPIED_LINES, F.sum("size") / F.col("total")).otherwise(0.0).alias("share"))
    each = stored(each.select("key", "copy", "at", "template").join(shared.select("key", "share"), "key"), "shares")
    apart = each.filter(F.col("share") < NEAR_COPY).select("template", "copy", (F.col("share") < OWN).cast("int").alias("own")).distinct()
    n = apart.groupBy("template").agg(F.count("*").alias("n"), F.sum("own").alias("n_own"))
    dropped = stored(n.filter(F.col("n") >= min_docs).select("template", (F.col("n_own") >= min_docs).alias("everywhere")), "dropped")
    gone = each.join(dropped, "template").filter(F.col("everywhere") | (F.col("share") < NEAR_COPY))
    return gone.groupBy("key").agg(F.collect_set("at").alias("places"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """docs with all its columns and rows, its text without recurring lines, and n_lines and n_dropped, which replace columns of that name.

    Without counts there are no such columns; instead a column n_chars, if docs has one, follows the text where it changed.

    A tree of fixed depth leads from a line's number of tokens over its leading tokens, LEADING tenths of them, to a leaf. In
    the leaf its template is what stays of it, STAYING tenths of its tokens at least, beside its leaf's other lines (see
    line_templates). A token with a digit, a link or an address is a variable field from the start.

    A template recurs if it occurs in at least min_docs different documents; those that are alike in all but blank lines and
    variable tokens are copies and count as one. It is dropped from every document if min_docs of its documents have less
    than OWN of their characters in recurring lines, whatever stands around it. If only less than NEAR_COPY of them, it is
    dropped but from near copies, documents with at least NEAR_COPY. A document with fewer than
    COPIED_LINES recurring lines counts as one with none. Otherwise it only recurs within near copies and stays,
    as they are left to a near-duplicate step; without this, the copies of an often copied text would all be emptied.

    A null text stays null with no line; an empty one has one blank line; blank lines stay. Repeated rows are treated alike;
    an empty table gives no row. Other line ends than "\\n" belong to the line. A document of recurring lines alone gets an
    empty text.
    """
    places = recurring_lines(docs, min_docs).withColumnRenamed("key", "key__")
    text = F.col("row__.text")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("places"), i))
    new = {
        "text": F.when(F.col("places").isNull(), text).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)),
        "n_dropped": F.when(F.col("places").isNull(), 0).otherwise(F.size("places")),
    }
    if not counts:
        new = {"text": new["text"]}
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(F.col("places").isNull(), F.col("row__.n_chars")).otherwise(F.length(new["text"]).cast(docs.schema["n_chars"].dataType))
        return with_lookup(docs, row_key(), places, new).select(*[F.col(f"`{c}`") for c in docs.columns])
    return with_lookup(docs, row_key(), places, new)


#: The definition in DuckDB SQL, over documents.
ORACLE = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
t AS (SELECT doc_id, pos, [CASE WHEN regexp_matches(x, '[0-9]') OR starts_with(x, 'http://') OR starts_with(x, 'https://') OR regexp_matches(x, '^[^@]+@.') THEN '<*>' ELSE x END
                          FOR x IN list_filter(regexp_split_to_array(line, '[ \\t\\f\\r]+'), lambda x: x <> '')] AS w FROM l),
m AS (SELECT doc_id, pos, w, array_to_string(w, ' ') AS line, len(w) AS n, w[1 : ({LEADING} * len(w) + 9) // 10] AS lead FROM t WHERE len(w) > 0),
copies AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS copy, sum(len(line)) AS total FROM m GROUP BY doc_id),
different AS (SELECT DISTINCT n, lead, line, w FROM m),
tok AS (SELECT n, lead, line, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM different),
often AS (SELECT n, lead, p, token, count(*) AS c FROM tok GROUP BY ALL),
counted AS (SELECT n, lead, line, p, token, c FROM tok JOIN often USING (n, lead, p, token)),
lowest AS (SELECT n, lead, line, list_sort(list(c), 'DESC')[({STAYING} * n + 9) // 10] AS c0 FROM counted GROUP BY n, lead, line),
templates AS (SELECT line, string_agg(CASE WHEN c >= c0 THEN '=' || token ELSE '*' END, ' ' ORDER BY p) AS template FROM counted JOIN lowest USING (n, lead, line) GROUP BY line),
e AS (SELECT m.doc_id, pos, len(m.line) AS size, copy, total, template FROM m JOIN templates USING (line) JOIN copies USING (doc_id)),
recurring AS (SELECT template FROM e GROUP BY template HAVING count(DISTINCT copy) >= {MIN_DOCS}),
r AS (SELECT * FROM e SEMI JOIN recurring USING (template)),
shares AS (SELECT doc_id, CASE WHEN count(*) >= {COPIED_LINES} THEN sum(size)::DOUBLE / any_value(total)::DOUBLE ELSE 0.0 END AS share FROM r GROUP BY doc_id),
dropped AS (SELECT template, count(DISTINCT copy) FILTER (share < {NEAR_COPY}) AS apart, count(DISTINCT copy) FILTER (share < {OWN}) AS own FROM r JOIN shares USING (doc_id) GROUP BY template),
gone AS (SELECT doc_id, list(DISTINCT pos) AS places FROM r JOIN shares USING (doc_id) JOIN dropped USING (template) WHERE apart >= {MIN_DOCS} AND (own >= {MIN_DOCS} OR share < {NEAR_COPY}) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN places IS NULL THEN text ELSE array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(places, i)], chr(10)) END AS text,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS INT) AS n_lines, CAST(coalesce(len(places), 0) AS INT) AS n_dropped
FROM documents d JOIN cut USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
