"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes if an earlier line (by document id, then line number) equals it
or, for lines of at least ``MIN_CHARS`` characters, is within ``edits`` edits of
it; the first of its kind stays. Shorter lines, too short to tell apart by a few
edits, go only if an earlier one equals them and they have a word.

Equal lines are found by a 128-bit hash, pre-aggregated before the shuffle, so
a line that a third of all documents share costs one row a task. The first
occurrences are joined on segments: each line is cut into ``edits + 1`` even
segments, and a line within the threshold must contain one of them unchanged,
at a place that its shift bounds. Each line is therefore indexed by (segment
number, length, segment), and probes, for each shorter or equal length in
reach, only the substrings that multi-match-aware selection leaves. A segment
that more than ``HOT`` lines share says too little: lines under such a key meet
on finer keys instead, all of the line but ``edits`` of twice as many pieces, one
of which two lines in reach must share as well. Of a finer key that more than
``CROWD`` lines share the pieces left out are halved again, down to single
characters; there the keys are the line with ``edits`` marks in the place of a character or
between two. Lines that share one are in reach, so each meets the
earliest only: no group of near copies is met pair by pair. Candidates
whose letter counts allow it are verified by the banded bit-parallel edit distance: one 64-bit word holds
the 2 * edits + 1 cells of a column, after the common ends are cut off.

Defined results: null and empty texts have no lines to remove; rows with the
same id and the same text are one document and lose the same lines; null ids
sort first; ``drop_repeated_lines`` drops documents that lose all their
lines; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import carried, discard, let, materialise, row_key, texts

EDITS = 2
MIN_CHARS = 30
HOT = 16  # lines that may share a segment before finer keys take its place
CROWD = 16  # lines that may share a finer key before its pieces are halved
COMMON = 20_000  # a line with more than one in so many occurrences is keyed once, other repeated lines once an occurrence
SLOTS = 1 << 20  # what document keys are taken modulo, to tell which documents hold wanted lines


def _segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(key, probe, a): the keys under which each line of (h, line, n) is indexed, and those it looks up (probe).

    A line is indexed by its own segments and looks up, beside these, what a
    line of the same or a smaller length in reach may have as a segment: segment
    ``i`` of lines ``less`` shorter, read ``shift`` away from its place. Edits
    before the segment bound its shift from the left, those after it from the
    right. Lengths are cut into edits + 1 even segments, the last ones longer by
    one if need be. The cases are rows, so that the generated code stays small.
    """
    parts = edits + 1
    wanted = [(i, less, shift) for less in range(edits + 1) for i in range(edits + 1)
              for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    cases = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(shift).alias("shift")) for i, less, shift in wanted])
    each = lines.select(F.col("h").alias("a"), "line", "n", F.inline(cases)).withColumn("length", F.col("n") - F.col("less"))
    each = each.withColumn("short", F.expr(f"cast(length div {parts} as int)"))
    plain = F.lit(parts) - (F.col("length") - F.col("short") * parts)  # segments that are not longer by one
    each = each.withColumns({"at": F.col("i") * F.col("short") + F.greatest(F.lit(0), F.col("i") - plain) + F.col("shift"),
                             "size": F.col("short") + F.when(F.col("i") >= plain, 1).otherwise(0)})
    inside = each.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    return inside.select(F.xxhash64("i", "length", F.substring("line", F.col("at") + 1, F.col("size"))).alias("key"),
                         ((F.col("less") != 0) | (F.col("shift") != 0)).alias("probe"), "a")


def _met(keys: DataFrame, most: int, state: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of lines that meet under a key that at most ``most`` lines own; (a, null, state) for each line under a more crowded one.

    One sort by key: each row sees the first ``most`` + 1 owners of its key, so
    it meets ``most`` lines at most. Repeated rows have one rank, so they count once.
    """
    same = Window.partitionBy("key")
    ranked = keys.withColumn("rank", F.dense_rank().over(same.orderBy("probe", "a")))
    owners = F.collect_set(F.when(~F.col("probe") & (F.col("rank") <= most + 1), F.col("a"))).over(same)
    seen = ranked.withColumn("owners", owners).filter(F.size("owners") > 0)
    others = F.filter("owners", lambda o: (o < F.col("a")) | (F.col("probe") & (o > F.col("a"))))
    met = seen.select("a", *state, F.explode(F.when(F.size("owners") > most, F.array(F.lit(None).cast("long"))).otherwise(others)).alias("b"))
    return met.select(F.when(F.col("b").isNull(), F.col("a")).otherwise(F.least("a", "b")).alias("a"),
                      F.when(F.col("b").isNotNull(), F.greatest("a", "b")).alias("b"),
                      *[F.when(F.col("b").isNull(), F.col(c)).alias(c) for c in state]).distinct()


def _left_out(edits: int, slots: int, apart: bool) -> list[tuple[tuple[int, ...], list[int]]]:
    """(slots left out, by how much each shifts what follows) for every choice of ``edits`` of the slots and every way to shift.

    A piece with k edits is left out together with k - 1 neighbours, so a run
    of r slots left out has at most r edits and shifts what follows by r at
    most; where in the run does not matter. The shifts end at the difference of the lengths.
    With ``apart``, slots are halves of pieces that need not be neighbours.
    """
    out = []
    for chosen in combinations(range(slots), edits):
        runs: list[int] = []
        for k, c in enumerate(chosen):
            if k and c == chosen[k - 1] + 1 and (c % 2 or not apart):
                runs[-1] += 1
            else:
                runs.append(1)
        for moves in product(*[range(-r, r + 1) for r in runs]):
            if sum(moves) >= 0:
                out.append((chosen, [(m > 0) - (m < 0) if k < abs(m) else 0 for r, m in zip(runs, moves, strict=True) for k in range(r)]))
    return out


def _start(pieces: int, piece: Column) -> Column:
    """Where a piece of a line of ``length`` starts; pieces of twice the number halve these."""
    return F.floor(F.col("length").cast("long") * piece / F.lit(pieces)).cast("int")


def _fine_keys(lines: DataFrame, edits: int, pieces: int, first: bool) -> DataFrame:
    """(key, probe, a, region, moves, length): lines (a, line, n, region, before) but for ``edits`` of the halves of the pieces in region.

    ``pieces`` is the number of the halves in a line of ``length``, the one
    that owns the key; a longer or shifted line looks it up (probe). The new
    region is what is left out. Halves shift the line as their pieces did (before), but for the first keys, where every shift is tried.
    """
    cases = []
    for chosen, moves in _left_out(edits, 2 * edits + 2 if first else 2 * edits, not first):
        after = [sum(m for c, m in zip(chosen, moves, strict=True) if c // 2 <= j) for j in range(edits)]
        shift = dict(zip(chosen, moves, strict=True))
        ends = [(shift.get(2 * j + 1), shift.get(2 * j + 2)) for j in range(edits)]  # halves that meet if the pieces are neighbours
        again = [None not in e and (e[0] * e[1] < 0 or abs(e[0]) < abs(e[1])) for e in ends]  # as neighbours, one run: another case has its shift
        cases.append(F.struct(*[F.array(*map(F.lit, v)).alias(k) for k, v in (("chosen", chosen), ("moves", moves), ("after", after), ("again", again))],
                              F.lit(sum(moves)).alias("less")))

    def fits(c: Column) -> Column:
        out, shift = F.lit(True), F.lit(0)
        for j in range(edits):
            shift = shift + F.get("before", F.lit(j))
            near = F.get("region", F.lit(j + 1)) == F.get("region", F.lit(j)) + 1 if j < edits - 1 else F.lit(False)
            out = out & F.when(near, ~F.get(c["again"], F.lit(j))).otherwise(F.get(c["after"], F.lit(j)) == shift)
        return out

    every = F.array(*cases)
    each = lines.select("a", "line", "n", "region", F.inline(every if first else F.filter(every, fits)))
    each = each.withColumn("length", F.col("n") - F.col("less")).withColumn(
        "region", F.transform("chosen", lambda c: F.get("region", F.shiftright(c, 1)) * 2 + c % 2))
    parts, at, shift = [], F.lit(0), F.lit(0)
    for j in range(edits + 1):
        end = _start(pieces, F.get("region", F.lit(j))) if j < edits else F.col("length")
        parts.append(F.substring("line", F.greatest(F.lit(0), at + shift) + 1, end - at))
        if j < edits:
            at, shift = _start(pieces, F.get("region", F.lit(j)) + 1), shift + F.get("moves", F.lit(j))
    return each.select(F.xxhash64(F.lit(pieces), "length", "region", *parts).alias("key"), F.exists("moves", lambda m: m != 0).alias("probe"),
                       "a", "region", "moves", "length")


def _earliest(lines: DataFrame, edits: int, pieces: int) -> DataFrame:
    """(a, b): the earliest line b that shares a marked form with a line of (a, at, line, region, moves, length), if it is not a itself.

    A form is the line with ``edits`` marks, each in the place of a character of
    the region or between two. Lines in reach whose edits lie in the region share one, and lines that share one are in reach.
    """
    runs, shift = [], F.lit(0)
    for j in range(edits):
        piece, to = F.get("region", F.lit(j)), shift + F.get("moves", F.lit(j))
        low, high = F.greatest(F.lit(0), _start(pieces, piece) + shift), F.least(F.length("line"), _start(pieces, piece + 1) + to)
        chars = F.slice(F.sequence(low, F.greatest(low, high)), 1, F.greatest(F.lit(0), high - low))
        runs.append(F.transform(F.sequence(low, F.greatest(low, high)), lambda g: F.struct(g.alias("place"), F.lit(0).alias("size"))))
        runs.append(F.transform(chars, lambda g: F.struct(g.alias("place"), F.lit(1).alias("size"))))
        shift = to
    marked = lines.withColumn("marks", F.array_distinct(F.concat(*runs)))
    forms = F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("at")))
    for _ in range(edits):
        forms = F.flatten(F.transform(forms, lambda f: F.transform(F.filter("marks", lambda m: m["place"] >= f["at"]), lambda m: F.struct(
            F.concat(f["text"], F.substring("line", f["at"] + 1, m["place"] - f["at"]), F.lit("\n")).alias("text"),  # no line holds a line feed
            (m["place"] + m["size"]).alias("at")))))
    whole = F.transform(forms, lambda f: F.xxhash64(F.concat(f["text"], F.substring("line", f["at"] + 1, F.length("line")))))
    keys = marked.select("a", "at", F.explode(F.array_distinct(whole)).alias("key"))
    best = keys.withColumn("best", F.min(F.struct("at", "a")).over(Window.partitionBy("key")))
    return best.groupBy("a").agg(F.min("best")["a"].alias("b")).filter("a <> b")


def _common_start(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving steps."""
    out = F.lit(0)
    for step in (1 << k for k in range(16, -1, -1)):
        out = let(out, lambda o, step=step: F.when(
            (F.length(a) >= o + step) & (F.length(b) >= o + step) & (F.substring(a, o + 1, F.lit(step)) == F.substring(b, o + 1, F.lit(step))), o + step).otherwise(o))
    return out


def edit_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of a and b if it is at most ``edits``, else a larger number.

    Banded bit-parallel: bit r of a word stands for row i - edits + r of
    column i; vp and vn mark where a column's cells rise or fall by one. The
    longer text is the pattern. The score runs down the band's lower diagonal,
    then along the last row.
    """
    band = 2 * edits + 1
    mask, diagonal = (1 << band) - 1, 1 << (band - 1)
    long = lambda v: F.lit(v).cast("long")
    bits = lambda x: x.bitwiseAND(long(mask))

    def run(p: Column, t: Column) -> Column:
        m, n = F.size(p), F.size(t)

        def column(state: Column, i: Column) -> Column:
            c = F.get(t, i)
            x = long(0)
            for r in range(band):
                x = x.bitwiseOR(F.when(F.coalesce(F.get(p, i - edits + r) == c, F.lit(False)), long(1 << r)).otherwise(long(0)))

            def step(x: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                d0 = bits((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn))

                def rest(d0: Column) -> Column:
                    hp = vn.bitwiseOR(long(mask) - bits(d0.bitwiseOR(vp)))
                    hn = d0.bitwiseAND(vp)
                    row = F.call_function("shiftright", long(diagonal), (i - (m - edits) + 1).cast("int"))
                    down = F.when(d0.bitwiseAND(long(diagonal)) == 0, 1).otherwise(0)
                    along = F.when(hp.bitwiseAND(row) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(row) != 0, 1).otherwise(0)
                    half = F.shiftright(d0, 1)
                    return F.struct(hn.bitwiseOR(long(mask) - bits(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"),
                                    (state["d"] + F.when(i < m - edits, down).otherwise(along)).alias("d"))
                return let(d0, rest)
            # the score falls by one in each of the last 2 * edits columns at most: beyond this it cannot come back
            return F.when(state["d"] > 3 * edits, state).otherwise(let(x, step))

        start = F.struct(long(((1 << (edits + 1)) - 1) << edits).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("d"))
        ran = F.aggregate(F.sequence(F.lit(0), n - 1), start, column, lambda s: s["d"])
        # a pattern no longer than the threshold has no diagonal phase; one text empty: the other's length
        return (F.when(m - n > edits, F.lit(edits + 1)).when(n == 0, m).when(m <= edits, F.levenshtein(F.array_join(p, ""), F.array_join(t, "")))
                .otherwise(ran))

    chars = lambda s: F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    end = lambda s, k: F.substring(s, k + 1, F.length(s))

    def cut(x: Column, y: Column) -> Column:
        return let(_common_start(x, y), lambda k: let(F.reverse(end(x, k)), lambda x2: let(F.reverse(end(y, k)), lambda y2: let(
            _common_start(x2, y2), lambda q: let(chars(end(x2, q)), lambda p: let(chars(end(y2, q)), lambda t: run(p, t)))))))

    return let(longer, lambda x: let(shorter, lambda y: cut(x, y)))


# Frequent letters; any set gives a right bound.
LETTERS = "etaoinsrhl"


def may_be_near(a: Column, b: Column, edits: int = EDITS) -> Column:
    """False only for texts further apart than ``edits``: an edit changes at most two letter counts by one."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    return sum((F.abs(count(a, c) - count(b, c)) for c in LETTERS), F.lit(0)) <= 2 * edits


def _lines(keyed: DataFrame, min_chars: int) -> DataFrame:
    return (keyed.select("_key", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .withColumn("long", F.length("line") >= min_chars).filter(F.col("long") | F.col("line").rlike("[^ \t-\r]")))


def _finer(crowd: DataFrame, edits: int) -> list[DataFrame]:
    """Tables with pairs (a, b) of the crowded lines (a, at, line, n): all that meet under a finer key of few lines, and the earliest one of a crowded place."""
    out, pieces, state = [], edits + 1, ("region", "moves", "length")
    todo, first = crowd.withColumn("region", F.array(*map(F.lit, range(pieces)))), True
    while True:  # ends when pieces are single characters at the latest
        pieces *= 2
        out.append(materialise(_met(_fine_keys(todo, edits, pieces, first), CROWD, state), "finer-pairs"))
        crowded = out[-1].filter("b is null")
        least, most = crowded.agg(F.min("length"), F.max("length")).first()
        if least is not None and least <= pieces:
            single = crowd.join(crowded.filter(F.col("length") <= pieces).select("a", *state), "a")
            out.append(materialise(_earliest(single, edits, pieces), "earliest-pairs"))
        if most is None or most <= pieces:
            return out
        deeper = crowded.filter(F.col("length") > pieces).select("a", "region", F.col("moves").alias("before"))
        todo, first = crowd.join(deeper, "a"), False


def near_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(first occurrence of each line, the lines among them that go).

    The first: h, h2 (hash of the line), at (doc_id, _key, line_no), long,
    whether the line takes part in the edit join, and how often it occurs. The second: h, h2, source (the earliest place of an earlier line in reach) and
    its distance.
    """
    keyed = row_key(texts(docs))
    occ = _lines(keyed, min_chars).select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), F.struct("doc_id", "_key", "line_no").alias("at"), "long")
    firsts = materialise(occ.groupBy("h", "h2", "long").agg(F.min("at").alias("at"), F.count("*").alias("times")), "first-lines")
    long = firsts.filter("long")

    def texts_at(places: DataFrame, known: DataFrame) -> DataFrame:
        """Lines of places (_key, line_no, h): h and line, from the documents ``known`` (_key, text); one row a content key."""
        lists = places.groupBy("_key").agg(F.collect_set(F.struct("line_no", "h")).alias("places"))
        own = known.groupBy("_key").agg(F.first("text").alias("text")).join(lists, "_key").select(F.split("text", "\n").alias("lines"), "places")
        each = own.select(F.inline(let(F.col("lines"), lambda ls: F.transform("places", lambda p: F.struct(p["h"].alias("h"), F.get(ls, p["line_no"]).alias("line"))))))
        return each.filter("h is not null and line is not null")  # said here, the optimizer need not add it to one use of a shared shuffle

    def texts_of(places: DataFrame) -> DataFrame:
        """Lines of places (_key, line_no, h). Documents whose key falls in no wanted slot stay out of the shuffle; the slots, at most SLOTS, are broadcast."""
        slot = F.pmod("_key", F.lit(SLOTS))
        some = keyed.select("_key", "text").withColumn("slot", slot).join(F.broadcast(places.select(slot.alias("slot")).distinct()), "slot", "left_semi")
        return texts_at(places, some.drop("slot"))

    def places_of(wanted: DataFrame) -> DataFrame:
        return long.join(wanted, "h", "left_semi").select("at._key", "at.line_no", "h")

    # several plans of modest size instead of one: each is written, as the driver holds a plan with all that it repeats.
    # Lines are keyed where their documents are read, so that no text is shuffled; the few common ones, fewer than COMMON, once each
    bar = max(1, (long.agg(F.sum("times")).first()[0] or 0) // COMMON)
    common = materialise(texts_of(long.filter(F.col("times") > bar).select("at._key", "at.line_no", "h")), "common-lines")
    rare = (_lines(keyed, min_chars).filter("long").select(F.xxhash64("line").alias("h"), "line")
            .join(F.broadcast(common.select("h")), "h", "left_anti"))
    lines = rare.unionByName(common).withColumn("n", F.length("line"))
    found = materialise(_met(_segment_keys(lines, edits), HOT), "met-lines")  # a crowded line has no b
    discard(common)
    met, crowded = [found], found.filter("b is null").select(F.col("a").alias("h"))
    crowd = None
    if not crowded.isEmpty():
        crowd = materialise(texts_of(places_of(crowded)).join(long.select("h", "at"), "h").groupBy(F.col("h").alias("a"))
                            .agg(F.min("at").alias("at"), F.first("line").alias("line")).withColumn("n", F.length("line")), "crowded-lines")
        met += _finer(crowd, edits)
    either = reduce(DataFrame.unionByName, [m.select("a", "b") for m in met])
    pairs = materialise(either.filter("a is not null and b is not null").distinct(), "line-pairs")
    for m in [*met, *([] if crowd is None else [crowd])]:
        discard(m)
    place = long.select("h", "h2", "at")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    text = texts_of(places_of(needed)).dropDuplicates(["h"])
    side = lambda n: place.join(text, "h").select(F.col("h").alias(n), F.col("h2").alias(f"{n}_2"), F.col("at").alias(f"{n}_at"), F.col("line").alias(f"{n}_line"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(may_be_near(F.col("a_line"), F.col("b_line"), edits))
    far = both.withColumn("distance", F.explode(F.array(edit_distance(F.col("a_line"), F.col("b_line"), edits)))).filter(F.col("distance") <= edits)
    later = F.col("a_at") > F.col("b_at")
    gone = (far.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("h"), F.when(later, F.col("a_2")).otherwise(F.col("b_2")).alias("h2"),
                       F.struct(F.when(later, F.col("b_at")).otherwise(F.col("a_at")).alias("source"), "distance").alias("best"))
            .groupBy("h", "h2").agg(F.min("best").alias("best")).select("h", "h2", "best.source", "best.distance"))
    near = materialise(gone, "near-lines")
    discard(pairs)
    return firsts, near


def removed_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_key, doc_id, line_no, distance, source_doc_id, source_line_no) of every line that goes; distance 0: an equal line came first."""
    firsts, near = near_lines(docs, edits, min_chars)
    occ = _lines(row_key(texts(docs)), min_chars).select("_key", "doc_id", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    first = firsts.join(near, ["h", "h2"], "left").filter((F.col("times") > 1) | F.col("source").isNotNull())
    own = F.struct("doc_id", "_key", "line_no").eqNullSafe(F.col("at"))
    all_ = occ.join(first, ["h", "h2"]).filter(~own | F.col("source").isNotNull())
    source = F.when(own, F.col("source")).otherwise(F.col("at"))
    return all_.select("_key", "doc_id", "line_no", F.when(own, F.col("distance")).otherwise(F.lit(0)).alias("distance"),
                       source["doc_id"].alias("source_doc_id"), source["line_no"].alias("source_line_no"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the lines that go, all columns; documents that lose all they had go too."""
    gone = removed_lines(docs, edits, min_chars).groupBy("_key").agg(F.collect_set("line_no").alias("_gone"))
    joined = carried(docs).join(gone, "_key", "left")
    stay = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone")), lambda i: F.get(ls, i))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), lambda ls: F.array_join(stay(ls), "\n")))
    out = joined.select("_row", "_gone", F.explode(F.array(kept)).alias("kept"))
    some = out.filter(F.col("_gone").isNull() | F.coalesce(F.col("kept"), F.lit("")).rlike("[^ \t-\r]"))
    return some.select(*[F.col("kept").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
