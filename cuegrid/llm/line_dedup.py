"""Line deduplication by an exact set-similarity join (operator 10). DataFrame functions only.

A line's tokens are its distinct 5-word shingles (as written); a line of fewer words is one token, its whole
word sequence. Two lines match when the Jaccard similarity of their token sets is at least 0.75; a
line is removed when any earlier line, in order of (doc_id, line number), matches it, in the same
document or another. Lines without words match nothing and stay.

1. Lines of equal text collapse to the first, by an aggregation that combines before it shuffles.
2. Prefix filter: in any one order of all tokens, two matching sets share a token among the first
   |x| - ceil(0.75 |x|) + 1 of each. Over all lines the order is that of the tokens' first words, of which no count has
   to be known and no set has to be made: the tokens up to a line's limit leave as rows. Lines that share
   none of them with another text match nothing and drop out. At most OFTEN lines, those with the most copies,
   go into this once and not once a copy.
3. The lines that are left are numbered in their order and their whole sets are made. Their tokens get the order that
   counts, rarest first: hashed counts of the tokens themselves (SLOTS counts, so of a size fixed
   beforehand), in steps above the usual count of a slot. Any such order gives the same matches;
   rarity keeps the posting lists short. Each line is held against two earlier ones, the first lines
   of the lists of its prefix. Confirmed ones go.
4. For the other lines every earlier line in their lists is a candidate unless sizes, positions, a 256-bit
   mark of the set or the distances to a common head exclude it; candidates are confirmed on the whole
   sets. So no match is missed, while thousands of near copies do not become rows of pairs.

Texts are read three times: for the lines, for the first prefixes, and for the whole sets of those lines alone
that share a token; the sets of all lines would take twice the input on disk.

Defined results: null text has no lines and stays null; null doc_ids come last in the order, texts of one
doc_id are ordered by their hashes; rows that repeat id and text are one document (its copies lose the
same lines); all columns are carried, whatever their names; very long texts and lines are taken whole;
an empty table gives an empty result. Texts, lines and documents are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.scratch import materialise, release, tidy

SHINGLE_WORDS = 5
MIN_PERCENT = 75
#: Entries of the hashed table of token counts.
SLOTS = 1 << 16
#: Steps of the rarity order for each doubling of a slot's count.
STEPS = 5
_BLANKS = "\t\n\x0b\x0c\r "
#: Longs in the mark of a token set.
MARKS = 4
#: Lines whose copies are left out where entries of lists are made (those with the most copies), and tokens whose entries
#: stay with their lines there.
OFTEN = 100
#: What identifies a document, and a line.
KEY = ["doc_key", "twin", "other_twin"]
PLACE = [*KEY, "line_no"]
#: What identifies the text of a line.
MARK = ["mark", "other_mark"]


def _split(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, line_no, line and whether its text is ``odd`` for every line with a word."""
    # First the text's own column, then its lines: beside the explosion it would be made for each line.
    rows = texts.select(*keep, "text", _odd(F.col("text")).alias("odd"))
    rows = rows.select(*keep, "odd", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.filter((F.ltrim("line") != "") & (~F.col("odd") | (F.btrim("line", F.lit(_BLANKS)) != "")))


def _lines(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, line_no, line and its ``words`` for every line with a word."""
    return _with_words(_split(texts, *keep), *keep, "line_no", "line")


def _marks() -> list[Column]:
    """128 bits of hashes of ``line``."""
    return [F.xxhash64(F.lit(salt), "line").alias(name) for salt, name in enumerate(MARK)]


def _odd(text: Column) -> Column:
    """The text has blanks other than spaces and line breaks."""
    return reduce(or_, [text.contains(blank) for blank in "\t\x0b\x0c\r"])


def _with_words(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``words`` of ``line``, in a text that is ``odd``. Lines with nothing but single spaces between
    words take the plain split, which is a column of its own as it is looked at before it is taken."""
    rows = rows.select(*dict.fromkeys((*keep, "odd", "line")), F.split("line", " ").alias("plain"))
    odd = F.col("odd") | F.array_contains("plain", "")
    words = F.when(odd, F.split(F.btrim("line", F.lit(_BLANKS)), r"[\x09-\x0D\x20]+")).otherwise(F.col("plain"))
    return rows.select(*keep, words.alias("words"))


def _last_start(of: str = "words") -> Column:
    """Where the last shingle starts."""
    return F.greatest(F.lit(0), F.size(of) - SHINGLE_WORDS)


def _shingle(*hashes: Column) -> Column:
    """The hash of up to SHINGLE_WORDS words, from the hashes of the words; those beyond the line's end are null
    and do not count."""
    return F.xxhash64(*hashes)


def _shingles(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the distinct hashes of the ``shingles`` of ``words``. Words are hashed once each, not once a shingle."""
    rows = rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    starts = F.slice("hashes", 1, _last_start("hashes") + 1)
    shingles = F.transform(starts, lambda h, i: _shingle(h, *[F.get("hashes", i + k) for k in range(1, SHINGLE_WORDS)]))
    return rows.select(*keep, F.array_distinct(shingles).alias("shingles"))


def token_ranks(texts: DataFrame) -> list[int]:
    """Rarity (0 to 127) of each slot: 64 is the median slot's count, STEPS more for each doubling. ``texts`` have
    ``text``, or the ``shingles`` that were made of their lines."""
    rows = texts if "shingles" in texts.columns else _shingles(_lines(texts), "line_no")
    tokens = rows.select(F.explode("shingles").alias("token")).select(F.col("token").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"))
    counts = tokens.groupBy("slot").agg(F.count("*").alias("n"))
    # A few long strings come back, not a row for each slot.
    entry = F.concat_ws(":", "slot", "n").alias("entry")
    packed = counts.select((F.col("slot") % 64).alias("row"), entry).groupBy("row").agg(F.array_join(F.collect_list("entry"), ",").alias("entries"))
    found = [0] * SLOTS
    for row in packed.collect():
        for item in row["entries"].split(","):
            slot, _, n = item.partition(":")
            found[int(slot)] = int(n)
    usual = max(1, median(found))
    return [max(0, min(127, 64 + math.floor(STEPS * math.log2(max(n, 0.5) / usual)))) for n in found]


def _tokens(rows: DataFrame, ranks: list[int], *keep: str) -> DataFrame:
    """``keep`` and the sorted ``tokens`` of ``shingles``, or of ``words``: a rank in the high byte and the high bits of the
    shingle's hash below, whose low bits are the slot of the rank."""
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")
    # Never null, and Spark then sorts plain longs.
    rank = lambda h: F.coalesce(F.get(table, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), F.lit(0).cast("long"))
    rows = rows if "shingles" in rows.columns else _shingles(rows, *keep)
    ranked = F.transform("shingles", lambda h: F.shiftleft(rank(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8)))
    return rows.select(*keep, F.sort_array(ranked).alias("tokens"))


def _entries(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``token`` for the prefix of ``words`` in the order of the tokens' first words. It ends with a whole
    word: as many different words as the prefix has tokens start at least as many tokens, all others come later.
    A line with fewer different words gives all its tokens. Sizes count repeated tokens, which only adds to a prefix."""
    starts = _last_start() + 1
    # A quarter of the tokens, and one: |x| - ceil(0.75 |x|) + 1.
    beyond = F.floor(starts * (100 - MIN_PERCENT) / 100).cast("int")
    rows = rows.select(*keep, "words", F.array_distinct(F.slice("words", 1, starts)).alias("firsts"))
    rows = rows.select(*keep, "words", F.get(F.sort_array("firsts"), beyond).alias("limit"))
    rows = rows.select(*keep, "words", "limit", F.explode(F.sequence(F.lit(0), _last_start())).alias("at"))
    rows = rows.filter(F.col("limit").isNull() | (F.get("words", "at") <= F.col("limit")))
    return rows.select(*keep, _shingle(*[F.get("words", F.col("at") + k) for k in range(SHINGLE_WORDS)]).alias("token"))


def _own(owner: str) -> Column:
    """What stands for the tokens of an owner that others are known to have: a token of its own."""
    return F.xxhash64(F.lit("own"), owner)


def _shared(entries: DataFrame, owner: str) -> DataFrame:
    """``entries`` (``owner``, token) of those tokens that different owners have or are known to have, and the first owner
    there, ``head``. Entries are shuffled once: the join and the aggregation under it read the same files."""
    # Without the filter Spark takes the repartition out of one side, and then shuffles both.
    rows = entries.repartition("token").filter(F.monotonically_increasing_id() >= 0)
    lists = rows.groupBy("token").agg(F.min(owner).alias("head"), F.max(owner).alias("last")).filter((F.col("head") < F.col("last")) | (F.col("token") == _own("head")))
    return rows.join(lists.select("token", "head").hint("shuffle_hash"), "token")


def _prefix() -> Column:
    size = F.size("tokens")
    return F.slice("tokens", 1, size - F.ceil(size * MIN_PERCENT / 100).cast("int") + 1).alias("prefix")


def _bits(part: int) -> Column:
    """64 bits of the set's mark: of the quarter of the tokens that ``part`` takes, every one sets a bit."""
    mine = F.col("token").bitwiseAND(F.lit(64 * (MARKS - 1))) == 64 * part
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("token").bitwiseAND(F.lit(63)).cast("int"))
    return F.bit_or(F.when(mine, bit).otherwise(F.lit(0).cast("long")))


def _identified(docs: DataFrame, *more: str) -> DataFrame:
    """doc_key, twin, other_twin, text: null ids have the largest key, and 128 bits of the text's hashes tell
    apart texts under a repeated id."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    hashed = [F.xxhash64(F.lit(salt), F.col("doc_id").isNull(), "text").alias(name) for salt, name in enumerate(KEY[1:])]
    return docs.select(key.alias("doc_key"), *hashed, "text", *more)


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with ``matches`` and the Jaccard ``distance`` of their whole sets."""
    one = sets.select(F.col("lid").alias("x"), F.col("shingles").alias("tx"))
    other = sets.select(F.col("lid").alias("y"), F.col("shingles").alias("ty"))
    rows = pairs.join(one, "x").join(other, "y")
    rows = rows.select("x", "y", F.size(F.array_intersect("tx", "ty")).alias("both"), (F.size("tx") + F.size("ty")).alias("sum"))
    union = F.col("sum") - F.col("both")
    return rows.select("x", "y", (F.col("both") * 100 >= MIN_PERCENT * union).alias("matches"), (1 - F.col("both") / union).alias("distance"))


def _needed(m: str, n: str) -> Column:
    """Smallest overlap at which sets of these sizes match: 100 k >= p (m + n - k)."""
    return F.ceil((F.col(m) + F.col(n)) * MIN_PERCENT / (100 + MIN_PERCENT) - 1e-9)


def _sharing(first: DataFrame, texts: DataFrame) -> DataFrame:
    """The lines of ``first`` (PLACE, MARK, n) that share a token of their prefix with another text, numbered in
    their order (lid, PLACE); materialised."""
    often = first.filter("n > 1").orderBy(F.desc("n"), *MARK).limit(OFTEN).select(*MARK, F.xxhash64(*PLACE).alias("own")).collect()
    copy = [F.col(c).isin([row[c] for row in often]) for c in MARK] + [~F.xxhash64(*PLACE).isin([row["own"] for row in often])]

    def entries(texts: DataFrame) -> DataFrame:
        lines = _split(texts, *KEY).select(*PLACE, *_marks(), "odd", "line")
        lines = lines.filter(~(copy[0] & copy[1] & copy[2])) if often else lines
        return _entries(_with_words(lines, "mark"), "mark")

    # A very common token would send its entries to one task. Which tokens those are is told from some documents, and that
    # different lines have them is then known: their entries go where their lines go. None is left out.
    some = entries(texts.filter(F.col("twin").bitwiseAND(F.lit(63)) == 0)).groupBy("token")
    some = some.agg(F.min("mark").alias("head"), F.max("mark").alias("last"), F.count("*").alias("n")).filter("head < last")
    common = [row["token"] for row in some.orderBy(F.desc("n"), "token").limit(OFTEN).select("token").collect()]
    every = entries(texts)
    if common:
        every = every.withColumn("token", F.when(F.col("token").isin(common), _own("mark")).otherwise(F.col("token")))
    # One of the hashes tells the owners of a token apart: that two lines match and have the same one is not to be expected.
    marks = _shared(every, "mark").select("mark").distinct()
    rows = first.join(marks, "mark", "left_semi").select(*PLACE).repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    return materialise(rows.withColumn("lid", F.monotonically_increasing_id()), "line-ordered")


def _later_matches(first: DataFrame, texts: DataFrame) -> DataFrame:
    """The places of the lines of ``first`` (PLACE, MARK, n) that an earlier one matches, materialised; ``first`` is released."""
    ordered = _sharing(first, texts)
    release(first)
    tidy(texts.sparkSession)
    asked = ordered.groupBy(*KEY).agg(F.collect_list(F.struct("line_no", "lid")).alias("asked"))
    # Rows that repeat id and text are one document: the join has sorted by KEY, so one of them is told without a shuffle.
    asked = texts.join(asked, KEY).withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY))).filter("copy = 1")
    asked = asked.select(F.split("text", "\n").alias("lines"), _odd(F.col("text")).alias("odd"), "asked").select("lines", "odd", F.explode("asked").alias("a"))
    asked = asked.select("a.lid", "odd", F.get("lines", "a.line_no").alias("line"))
    sets = materialise(_shingles(_with_words(asked, "lid"), "lid"), "line-sets")

    ranks = token_ranks(sets)
    prefixes = materialise(_tokens(sets, ranks, "lid").select("lid", F.size("tokens").alias("m"), _prefix()), "line-prefixes")
    shared = materialise(_shared(prefixes.select("lid", F.explode("prefix").alias("token")), "lid"), "line-shared")
    earlier = F.col("head") < F.col("lid")
    pivots = shared.groupBy("lid").agg(F.min("head").alias("pivot"), F.coalesce(F.max(F.when(earlier, F.col("head"))), F.min("head")).alias("other"))
    pivots = materialise(pivots, "line-pivots")
    tidy(texts.sparkSession)

    # Two earlier lines for each line, the heads of its lists: stars, not pairs.
    ask = F.explode(F.array_distinct(F.array("pivot", "other")))
    star = pivots.select(F.col("lid").alias("x"), ask.alias("y")).filter("y < x")
    star = materialise(_measured(star, sets), "line-star")
    gone = star.filter("matches").select(F.col("x").alias("lid")).distinct()

    # Every earlier candidate of the lines that neither explains. What cannot match is ruled out in the
    # join: by sizes, by position, by marks (a token that only one set has changes at most one bit),
    # and, Jaccard distance being a metric, by distances to the same head that differ too much.
    far = star.join(pivots.select(F.col("lid").alias("x"), F.col("pivot").alias("y")), ["x", "y"]).select(F.col("x").alias("lid"), "distance")
    facts = pivots.join(far, "lid", "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    left = facts.filter("pivot < lid").join(gone, "lid", "left_anti")
    # Only lists that hold such a line go on.
    lists = shared.join(left.select("lid"), "lid", "left_semi").filter("head < lid").select("token").distinct()
    bits = [f"bits{k}" for k in range(MARKS)]
    members = shared.join(lists, "token", "left_semi").select("lid").distinct()
    marks = sets.select("lid", F.explode("shingles").alias("token")).groupBy("lid").agg(*[_bits(k).alias(bits[k]) for k in range(MARKS)])
    known = prefixes.join(members, "lid").join(marks, "lid").join(facts, "lid")
    known = known.select("lid", "m", "pivot", "other", "distance", *bits, F.posexplode("prefix").alias("at", "token"))
    known = materialise(known.join(lists, "token", "left_semi"), "line-known")
    release(shared)
    tidy(texts.sparkSession)
    names = ["token", "lid", "m", "at", "pivot", "distance", *bits]
    right = known.select(*[F.col(c).alias(f"{c}_y") for c in names])
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_y"))) for b in bits), F.lit(0))
    fits = (
        (F.col("token") == F.col("token_y"))
        & (F.col("lid_y") < F.col("lid"))
        & (F.least("m", "m_y") * 100 >= F.greatest("m", "m_y") * MIN_PERCENT)
        & (F.least(F.col("m") - F.col("at"), F.col("m_y") - F.col("at_y")) >= _needed("m", "m_y"))
        & (differ <= F.col("m") + F.col("m_y") - 2 * _needed("m", "m_y"))
        & (F.col("lid_y") != F.col("pivot"))
        & (F.col("lid_y") != F.col("other"))
        & ((F.col("pivot") != F.col("pivot_y")) | (F.abs(F.col("distance") - F.col("distance_y")) <= (100 - MIN_PERCENT) / 100 + 1e-9))
    )
    rest = known.join(gone, "lid", "left_anti").join(right, fits).select(F.col("lid").alias("x"), F.col("lid_y").alias("y")).distinct()
    also = _measured(rest, sets).filter("matches").select(F.col("x").alias("lid"))
    matched = materialise(gone.union(also).distinct(), "line-matched")
    result = materialise(ordered.join(matched, "lid", "left_semi").select(*PLACE), "line-later")
    for used in (ordered, prefixes, pivots, sets, star, known, matched):
        release(used)
    return result


def removed_lines(docs: DataFrame) -> DataFrame:
    """The KEY of a document and ``gone``, the numbers of its lines that an earlier line matches, for
    the documents of ``docs`` (doc_id, text) that have such lines; materialised."""
    texts = _identified(docs.filter(F.col("text").isNotNull()))
    place = F.struct(*PLACE)
    lines = materialise(_split(texts, *KEY).select(*PLACE, *_marks()), "line-places")
    first = lines.groupBy(*MARK).agg(F.min(place).alias("id"), F.count("*").alias("n"))
    first = materialise(first.select(*MARK, "id.*", "n"), "line-first")
    again = lines.join(first.filter("n > 1").select(*MARK, place.alias("id")), MARK).filter(place != F.col("id")).select(*PLACE)
    again = materialise(again, "line-again")
    release(lines)
    tidy(docs.sparkSession)
    later = _later_matches(first, texts)
    found = materialise(later.union(again).groupBy(*KEY).agg(F.collect_set("line_no").alias("gone")), "line-removed")
    release(later)
    release(again)
    tidy(docs.sparkSession)
    return found


def _rewritten(docs: DataFrame) -> DataFrame:
    """``docs`` with the text changed, columns named by position, so that no name clashes: ``c0``, ``c1``, ...,
    then ``lines`` and ``removed``, the counts of lines and of removed ones."""
    place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    text, own = F.col(place["text"]), docs.toDF(*place.values())
    gone = removed_lines(own.select(F.col(place["doc_id"]).alias("doc_id"), text.alias("text")))
    keys = _identified(own.select("*", F.col(place["doc_id"]).alias("doc_id"), text.alias("text")), *own.columns).drop("text")
    # The lines are a column of their own, read twice: an expression would be evaluated for every line.
    joined = keys.join(gone.hint("shuffle_hash"), KEY, "left").withColumn("parts", F.when(F.col("gone").isNotNull(), F.split(text, "\n")))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    rest = F.array_join(F.transform(numbers, lambda i: F.get("parts", i)), "\n")
    joined = joined.withColumn("rest", F.when(F.col("gone").isNull(), text).otherwise(rest))
    columns = {name: F.col(c) for name, c in place.items()} | {"text": F.col("rest")}
    if "n_chars" in place:
        length = F.when(F.col("gone").isNull(), F.col(place["n_chars"])).otherwise(F.length("rest"))
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = F.when(text.isNull(), 0).otherwise(breaks + 1).cast("long")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return joined.select(*[columns[name].alias(c) for name, c in place.items()], lines.alias("lines"), removed.alias("removed"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with every later matching line removed (and ``n_chars`` set anew if there is one); all rows
    and columns stay."""
    return _rewritten(docs).drop("lines", "removed").toDF(*docs.columns)


def line_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the text that is left, and the counts of lines and of removed ones for every row of ``docs``."""
    return _rewritten(docs.select("doc_id", "text")).toDF("doc_id", "text", "n_lines", "n_removed")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = line_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
words AS (
  SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines),
tokens AS (
  SELECT DISTINCT doc_id, line_no, md5(array_to_string(w[i : i + 4], ' ')) AS t
  FROM (SELECT doc_id, line_no, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sets AS (
  SELECT doc_id, line_no, md5(string_agg(t, '' ORDER BY t)) AS s, count(*) AS n FROM tokens GROUP BY ALL),
firsts AS (SELECT s, n, min((doc_id, line_no)) AS id FROM sets GROUP BY ALL),
own AS (SELECT f.s, t.t FROM firsts f JOIN tokens t ON t.doc_id = f.id[1] AND t.line_no = f.id[2]),
common AS (SELECT a.s AS a, b.s AS b, count(*) AS k FROM own a JOIN own b ON a.t = b.t AND a.s <> b.s GROUP BY ALL),
matched AS (
  SELECT DISTINCT a AS s FROM common JOIN firsts x ON x.s = a JOIN firsts y ON y.s = b
  WHERE y.id < x.id AND 100 * k >= 75 * (x.n + y.n - k)),
gone AS (
  SELECT s.doc_id, s.line_no FROM sets s JOIN firsts f ON f.s = s.s
  WHERE (s.doc_id, s.line_no) <> f.id OR s.s IN (SELECT s FROM matched)),
done AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(x.text, '')) AS text_sha256
FROM documents d LEFT JOIN done x USING (doc_id)
"""
