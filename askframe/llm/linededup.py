"""Line deduplication: a suffix array over sequences of line ids, by distributed prefix doubling, in DataFrames only.

A document is the sequence of its lines that aren't blank. Ranks for runs of 1, 2, 4, ... lines come from sorting pairs
of ranks of half the length; positions whose run occurs once drop out of each round. Two runs of m lines are equal when
the ranks of their first and last 2^k lines are (2^k <= m), so one group of such a key is the interval of suffixes that
share m lines at least. Whatever lies in a repeated run that is long enough goes, but for its first copy.

Only as many rounds are needed as it takes to reach ``min_words`` words with lines of one word each: longer repeats are
unions of the shortest ones that are long enough, from a fixed start or to a fixed end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askframe.llm.common import BROADCAST_BYTES, Scratch, cut, hash128

#: Words that a repeated run of lines must have for its later copies to go.
MIN_WORDS = 8
_DOC = ["_k", "_null", "_h"]


def doc_key(id_col: str, text_col: str) -> list[Column]:
    """Columns that identify a document: its id, whether that is null, and a hash of its text (ids may repeat)."""
    key = F.col(id_col)
    return [
        F.coalesce(key, F.lit(0).cast("long")).alias("_k"),
        key.isNull().alias("_null"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"),
    ]


def _positions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line that isn't blank: document, index among those lines, line number, hash and words."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    full = F.filter(numbered, lambda s: s["line"].rlike(r"[^ \t]"))
    rows = df.select(*doc_key(id_col, text_col), F.posexplode_outer(full).alias("_i", "_s")).where("_i is not null")
    line = F.col("_s.line")
    words = F.size(F.array_remove(F.split(line, r"[ \t]+", -1), ""))
    a, b = hash128(line)
    return rows.select(*_DOC, "_i", F.col("_s.at").alias("_at"), a.alias("_a"), b.alias("_b"), words.alias("_w"))


def _ranked(rows: DataFrame, keys: list[str], rank: str, scratch: Scratch) -> DataFrame:
    """``rows`` whose ``keys`` occur more than once, with the keys' rank in sorted order.

    After a range partitioning and a sort, row numbers with the partition in their upper bits rise with the keys; they
    are materialised at once, as another run might put the limits elsewhere.
    """
    repeated = rows.groupBy(*keys).count().where("count > 1").drop("count")
    ordered = repeated.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(rank, F.monotonically_increasing_id())
    return rows.join(scratch.cut(ordered), keys).drop(*keys)


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Document keys with ``_lines``, the numbers of the lines to remove, for the documents that lose any."""
    levels = max(0, min_words.bit_length() - 1)
    scratch = Scratch(df.sparkSession)
    rows = scratch.cut(_ranked(_positions(df, id_col, text_col), ["_a", "_b"], "_r0", scratch))
    scratch.keep(rows)
    in_doc = Window.partitionBy(*_DOC).orderBy("_i")
    for k in range(levels):
        step = 1 << k
        # lines that occur once have left gaps, so the run after this one is looked up by index
        later = rows.select(*_DOC, (F.col("_i") - step).alias("_i"), F.col(f"_r{k}").alias("_next")).where("_next is not null")
        pairs = rows.where(f"_r{k} is not null").join(later, [*_DOC, "_i"]).select(*_DOC, "_i", f"_r{k}", "_next").distinct()
        named = _ranked(pairs, [f"_r{k}", "_next"], f"_r{k + 1}", scratch)
        rows = scratch.cut(rows.distinct().join(named, [*_DOC, "_i"], "left"))
        scratch.keep(rows)
    # stretches of consecutive indexes, and in each the words before and with a line
    stretch = F.col("_i") - F.row_number().over(in_doc)
    runs = rows.distinct().withColumn("_g", stretch)
    in_run = Window.partitionBy(*_DOC, "_g").orderBy("_i")
    words = F.sum("_w").over(in_run.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("_sum", words)
    ranks = F.array(*[F.col(f"_r{k}") for k in range(levels + 1)])
    near = F.collect_list(F.struct("_i", "_sum", "_w", ranks.alias("ranks")))
    ahead = in_run.rowsBetween(0, min_words - 1)
    behind = in_run.rowsBetween(1 - min_words, 0)
    first = F.col("_sum") - F.col("_w")
    shown = runs.withColumn("_ahead", near.over(ahead)).withColumn("_behind", near.over(behind))
    forward = F.filter("_ahead", lambda s: s["_sum"] - first >= min_words)
    backward = F.filter("_behind", lambda s: F.col("_sum") - s["_sum"] + s["_w"] >= min_words)
    ends = shown.select(*_DOC, "_i", "_ahead", "_behind", F.try_element_at(forward, F.lit(1))["_i"].alias("_to"), F.try_element_at(backward, F.lit(-1))["_i"].alias("_from"))
    ends = ends.select(
        *_DOC,
        F.explode(
            F.array(
                F.struct(F.col("_i").alias("s"), F.col("_to").alias("e"), F.slice("_ahead", 1, F.coalesce(F.col("_to") - F.col("_i") + 1, F.lit(1))).alias("of")),
                F.struct(
                    F.col("_from").alias("s"),
                    F.col("_i").alias("e"),
                    F.slice("_behind", -F.coalesce(F.col("_i") - F.col("_from") + 1, F.lit(1)), F.coalesce(F.col("_i") - F.col("_from") + 1, F.lit(1))).alias("of"),
                ),
            )
        ).alias("run"),
    ).where("run.s is not null and run.e is not null")
    length = F.col("run.e") - F.col("run.s") + 1
    level = F.floor(F.log2(length.cast("double"))).cast("int")
    span = F.shiftleft(F.lit(1), 0)
    for k in range(1, levels + 1):
        span = F.when(level >= k, F.lit(1 << k)).otherwise(span)
    keyed = ends.select(
        *_DOC,
        F.col("run.s").alias("s"),
        F.col("run.e").alias("e"),
        length.alias("m"),
        F.try_element_at(F.try_element_at(F.col("run.of"), F.lit(1))["ranks"], level + 1).alias("x"),
        F.try_element_at(F.try_element_at(F.col("run.of"), (length - span + 1).cast("int"))["ranks"], level + 1).alias("y"),
    )
    keyed = scratch.cut(keyed.where("x is not null and y is not null").distinct())
    place = F.struct("_null", "_k", "_h", "s")
    first_copy = keyed.groupBy("m", "x", "y").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # materialised, the first copies get an exchange of their own, and Spark can split the join at a run with many copies
    later = keyed.join(scratch.cut(first_copy), ["m", "x", "y"]).where(F.col("first") < place)
    gone = later.select(*_DOC, F.explode(F.sequence("s", "e")).alias("_i")).distinct()
    numbers = rows.select(*_DOC, "_i", "_at").distinct()
    found = cut(gone.join(numbers, [*_DOC, "_i"]).groupBy(*_DOC).agg(F.sort_array(F.collect_list("_at")).alias("_lines")))
    scratch.close()
    return found


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the lines of later copies taken out of the text, and ``n_lines`` and ``n_removed`` added.

    A run of whole lines, blank ones aside, with ``min_words`` words or more (split at spaces and tabs) that also starts
    earlier, in the order of id and line, is a later copy; overlapping copies within one document count too. Shorter
    repeats, blank lines and all other lines stay as they are, in order. Null texts stay null with no lines; an empty
    text is one blank line. A null id comes last in the order. Rows with equal id and text are one document: they lose
    the same lines and none for each other. Columns of the same names as the two added are replaced; an empty table
    gives an empty result. Hot lines are counted before they are joined, and the joins can be split at a hot key.
    """
    gone = repeated_lines(df, id_col, text_col, min_words)
    # a row holds its key and four bytes a line
    size = gone.agg(F.sum(F.size("_lines") * 4 + 64)).first()[0] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    # the row travels as one struct, so that none of its columns meets one of ours
    keyed = df.select(F.struct(*kept).alias("_row"), *doc_key(id_col, text_col))
    lines = F.split(F.col(f"_row.`{text_col}`"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_lines", i)), "\n")
    own = {c: F.col(f"_row.`{c}`") for c in kept}
    own[text_col] = F.when(F.col("_lines").isNull(), own[text_col]).otherwise(left)
    return keyed.join(gone, _DOC, "left").select(
        *[column.alias(c) for c, column in own.items()],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: Rows of a document table as dedup_lines gives them: id, lines, lines removed and a hash of the text that is left.
SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), full_lines AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i,
         len(list_filter(string_split_regex(line, '[ \t]+'), lambda x: x != '')) AS w
  FROM raw WHERE regexp_matches(line, '[^ \t]')
), summed AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS up_to FROM full_lines
), reach AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {w} - 1 AND b.up_to - a.up_to + a.w >= {w} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {w} - 1 AND b.up_to - a.up_to + a.w >= {w} GROUP BY b.doc_id, b.i
), runs AS (
  SELECT r.doc_id, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.i) AS run
  FROM reach r JOIN full_lines l ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e GROUP BY ALL
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS copy FROM runs
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM firsts f JOIN full_lines l ON l.doc_id = f.doc_id AND l.i BETWEEN f.s AND f.e WHERE copy > 1
)
SELECT r.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos GROUP BY r.doc_id
""".replace("{w}", str(MIN_WORDS))
