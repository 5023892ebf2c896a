"""Repeated lines: equal ones of any length by their hashes, long ones also some edits apart by a segment-partition join.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraft.llm.common import sized
from lexigraft.llm.components import connected_components
from lexigraft.session import materialize

#: Edits between two lines of a class if no other number is asked for, and what a line must have to be compared at all, that is, for equality.
THRESHOLD, MIN_CHARS = 1, 1
#: Edits that the query allows.
EDITS = 4
#: Characters of a line per edit; shorter lines are compared for equality only: one edit, or chance, makes them equal.
NEAR_CHARS = 30
#: Lines under one key are compared pair by pair; more of them are told apart by further keys first.
PAIRWISE = 8
#: Lines of a still crowded key that one cell holds.
CELL = 128
#: Characters at both ends of two lines that are compared before the whole lines.
ENDS = 48
#: Characters that are compared at both ends of what two lines do not begin or end with in common.
MID_ENDS = 24
#: What the characters of the two halves of a line are counted by, besides the rest; one byte of a signature each.
CLASSES = [*"abcdefghijklmnopqrstuvwxyz ", "01234", "56789", ".,;:'", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
#: Columns of a signature.
SIGNS = [f"sign{i}" for i in range(8)]
#: Powers of two up to which equal beginnings and ends of two lines are looked for.
STEPS = [1 << k for k in range(13, -1, -1)]


def edit_distance(chars_a: Column, chars_b: Column, most: int) -> Column:
    """Edit distance of two texts, given as columns of characters, that differ by ``most`` characters in length at most.

    More than ``most`` if it is larger. Both must be columns of a table: an expression would be evaluated per step.

    Bit-parallel over a band of ``2 * most + 1`` rows around the diagonal: the vertical differences of a column
    are two bit vectors, and one step moves the band down its diagonal. Behind the last row of ``a`` the
    distance is followed along that row.
    """
    width = 2 * most + 1
    mask, top = (1 << width) - 1, 1 << (2 * most)
    n_a = F.size(chars_a)

    def column(state: Column, step: Column) -> Column:
        j, c = step["j"], step["c"]
        equal = F.lit(0)
        for bit in range(width):
            at = j - most + bit
            same = (at >= 0) & (F.get(chars_a, F.greatest(at, F.lit(0))) == c)
            equal = equal.bitwiseOR(F.when(F.coalesce(same, F.lit(False)), 1 << bit).otherwise(0))
        vp, vn = state["vp"], state["vn"]
        d0 = (equal.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(equal).bitwiseOR(vn).bitwiseAND(F.lit(mask))
        step1 = F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), state["d"].alias("d"), j.alias("j"))
        return F.transform(F.array(step1), _next)[0]

    def _next(s: Column) -> Column:
        d0, vp, vn, d, j = s["d0"], s["vp"], s["vn"], s["d"], s["j"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(mask)))
        hn = d0.bitwiseAND(vp)
        half = F.shiftright(d0, 1)
        # The last row of the band is still above the last row of a, or it is that row's bit.
        row = n_a - 1 - j + most
        below = F.when(row >= 2 * most, F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)).otherwise(
            F.call_function("shiftright", hp, row).bitwiseAND(F.lit(1))
            - F.call_function("shiftright", hn, row).bitwiseAND(F.lit(1))
        )
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(F.lit(mask)).alias("vp"),
            half.bitwiseAND(hp).bitwiseAND(F.lit(mask)).alias("vn"),
            (d + below).alias("d"),
        )

    steps = F.transform(chars_b, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
    first = F.struct(
        F.lit((mask >> most) << most).alias("vp"), F.lit(0).alias("vn"), F.least(F.lit(most), n_a).alias("d")
    )
    return F.aggregate(steps, first, column, lambda s: s["d"])


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, row, pos, line)``: all lines with a word; ``row`` tells texts under one id apart."""
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")
    )
    return base.where((F.char_length("line") >= MIN_CHARS) & (F.ltrim("line", F.lit(" \t\n\x0b\x0c\r")) != ""))


def allowed_edits(n: Column, edits: int) -> Column:
    """Edits between lines whose shorter one has ``n`` characters."""
    return F.least((n / NEAR_CHARS).cast("int"), F.lit(edits))


def _layout(n: Column, edits: int, own: bool) -> Column:
    """How lines of about ``n`` characters are cut: the shortest of them, their edits at most, and the width of a segment.

    Lines are of one kind if their lengths agree in the first three binary digits.
    """
    step = F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 3)
    low = (n - n % step).cast("int")
    most = allowed_edits(low + step - 1, edits)
    width = (low / (most + 1)).cast("int")
    return F.struct(low.alias("low"), most.alias("most"), width.alias("width"), F.lit(own).alias("own"))


def _places(most: int) -> list[tuple[int, int]]:
    """Segments of a line with ``most`` edits, each with all places by which it can be moved.

    There are ``most + 1`` segments, the first half of them counted from the front and the others from the back. One of
    them is without an edit and has at most as many edits before it as there are segments, and not more behind it
    than there are segments; that is how far it can be moved, seen from the nearer end.
    """
    return [(k, s) for k in range(most + 1) for s in range(-min(k, most - k), min(k, most - k) + 1)]


def _placed(lines: DataFrame, edits: int) -> DataFrame:
    """One row per ``part`` and ``shift`` of a line that is cut between ``begin`` and ``end``, adding its number ``place`` and where it begins, ``at``."""
    table = [F.array(*[F.struct(F.lit(k).alias("part"), F.lit(s).alias("shift")) for k, s in _places(e)]) for e in range(1, edits + 1)]
    rows = lines.where("width > 0").select("*", F.explode(F.element_at(F.array(*table), F.col("most"))).alias("_place"))
    rows = rows.select(*lines.columns, "_place.part", "_place.shift")
    from_back = F.col("end") - (F.col("most") + 1 - F.col("part")) * F.col("width")
    at = F.when(2 * F.col("part") <= F.col("most"), F.col("begin") + F.col("part") * F.col("width")).otherwise(from_back) + F.col("shift")
    return rows.withColumn("at", at).where("at >= begin AND at + width <= end")


def _segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``(lid, key, indexed, n, low, most, width, part, at)``: hashes of the segments of a line, one more than its edits.

    A line is indexed by its own segments and looked up by those moved by as many places as edits can move them. A line
    that is hardly longer than a shorter kind is looked up among those too. In a line of ASCII characters only, places
    are found by bytes.
    """
    kinds = lines.select("lid", "line", "n", _layout(F.col("n"), edits, True).alias("kind"))
    kinds = kinds.withColumn("less", _layout(F.col("kind.low") - 1, edits, False))
    near = (F.col("n") - F.col("kind.low") < F.col("less.most")) & (F.col("kind.low") > NEAR_CHARS)
    both = F.explode(F.array_compact(F.array("kind", F.when(near, F.col("less"))))).alias("kind")
    kinds = kinds.select("lid", "line", F.encode("line", "UTF-8").alias("bytes"), (F.octet_length("line") == F.col("n")).alias("ascii"), "n", both)
    kinds = kinds.select("lid", "line", "bytes", "ascii", F.lit(0).alias("begin"), F.col("n").alias("end"), "kind.*")
    rows = _placed(kinds, edits)
    by_char = F.substring("line", F.col("at") + 1, F.col("width")).cast("binary")
    piece = F.when(F.col("ascii"), F.substring("bytes", F.col("at") + 1, F.col("width"))).otherwise(by_char)
    indexed = (F.col("own") & (F.col("shift") == 0)).alias("indexed")
    return rows.select("lid", F.xxhash64("low", "part", piece).alias("key"), indexed, F.col("end").alias("n"), "low", "most", "width", "part", "at")


def _further_keys(members: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``(lid, key, indexed, n)`` for lines under a crowded key: what stands beside their common segment is cut in the same way.

    Before segment number k there are at most k edits, behind it at most the others. The side with more room is taken.
    A line's text is fetched once for all its keys.
    """
    behind = 2 * F.col("part") <= F.col("most")
    per_line = members.groupBy("lid").agg(F.collect_list(F.struct("key", "indexed", "low", "most", "width", "part", "at")).alias("under"))
    beside = per_line.join(texts, "lid").select("lid", "n", "line", F.explode("under").alias("_under")).select("lid", "n", "line", "_under.*").select(
        "lid",
        "n",
        "line",
        "key",
        "indexed",
        F.when(behind, F.col("at") + F.col("width")).otherwise(F.lit(0)).alias("begin"),
        F.when(behind, F.col("n")).otherwise(F.col("at")).alias("end"),
        F.when(behind, F.col("most") - F.col("part")).otherwise(F.col("part")).alias("most"),
        (F.col("low") - F.when(behind, F.col("part") + 1).otherwise(F.col("most") + 1 - F.col("part")) * F.col("width")).alias("room"),
    )
    rows = _placed(beside.withColumn("width", (F.col("room") / (F.col("most") + 1)).cast("int")).drop("room"), edits)
    key = F.xxhash64("key", "part", F.substring("line", F.col("at") + 1, F.col("width")))
    return rows.select("lid", key.alias("key"), (F.col("indexed") & (F.col("shift") == 0)).alias("indexed"), "n")


def _signed(lines: DataFrame) -> DataFrame:
    """``lines(lid, line, n)`` with ``half`` and a signature of how often as many characters at both ends are of each class.

    A count is eight bits that go through 16 values, of which neighbours differ in one bit. An edit changes two counts by
    one at most: a character is replaced, or one comes in and another is moved out of the half. The halves are counted from
    the nearer end and do not overlap, so lines with k edits between them differ in at most 2 k bits.
    """
    ring = F.array(*[F.lit((1 << m) - 1 if m <= 8 else 255 & ~((1 << (m - 8)) - 1)).cast("bigint") for m in range(16)])
    half = (_layout(F.col("n"), 1, True)["low"] / 2).cast("int")
    rows = lines.select("lid", "line", "n", half.alias("half"))
    rows = rows.select("lid", "n", "half", F.substring("line", F.lit(1), F.col("half")).alias("front"), F.right("line", F.col("half")).alias("back"))
    signs = []
    for side in ("front", "back"):
        counts = [F.col("half") - F.char_length(F.replace(side, F.lit(c)) if len(c) == 1 else F.translate(side, c, "")) for c in CLASSES]
        names = [f"{side}{i}" for i in range(len(CLASSES) + 1)]
        rows = rows.select("*", *[c.alias(n) for c, n in zip(counts, names)])
        rows = rows.withColumn(names[-1], F.expr(" - ".join(["half", *names[:-1]])))
        for j in range(0, len(names), 8):
            sign = F.lit(0).cast("bigint")
            for i, name in enumerate(names[j : j + 8]):
                sign = sign.bitwiseOR(F.shiftleft(F.element_at(ring, (F.col(name) % 16 + 1).cast("int")), 8 * i))
            signs.append(sign)
    return rows.select("lid", "n", "half", *[c.alias(name) for c, name in zip(signs, SIGNS)])


def _alike(edits: int) -> Column:
    """Whether lines ``(n, half, signature)`` and ``(n_v, half_v, signature_v)`` can belong to near lines, by their lengths and
    characters; those of halves of unlike sizes are not compared."""
    most = allowed_edits(F.least("n", "n_v"), edits)
    bits = F.lit(0)
    for c in SIGNS:
        bits = bits + F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_v")))
    return (F.abs(F.col("n") - F.col("n_v")) <= most) & ((F.col("half") != F.col("half_v")) | (bits <= 2 * most))


def _second(rows: DataFrame, *keys: str) -> DataFrame:
    """Columns for the second line of a pair, with ``_v`` behind their names but those of ``keys``."""
    return rows.select(*keys, *[F.col(c).alias(f"{c}_v") for c in rows.columns if c not in keys])


def _lengths_agree(edits: int) -> Column:
    return F.abs(F.col("n") - F.col("n_v")) <= allowed_edits(F.least("n", "n_v"), edits)


def _in_pairs(members: DataFrame, edits: int) -> DataFrame:
    """``(u, v)``: indexed lines with every other line under their key whose length allows it."""
    index = _second(members.where("indexed").select("key", "lid", "n"), "key")
    pairs = members.select("key", "lid", "indexed", "n").join(index, "key").where("lid != lid_v AND (NOT indexed OR lid > lid_v)")
    return pairs.where(_lengths_agree(edits)).select(F.col("lid").alias("u"), F.col("lid_v").alias("v"))


def _both(pairs: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """Pairs ``(u, v)`` with columns of both lines, those of the second one with ``_v`` behind their names."""
    rows = texts.select("lid", "n", *columns)
    first = pairs.join(rows.withColumnRenamed("lid", "u"), "u")
    return first.join(_second(rows.withColumnRenamed("lid", "v"), "v"), "v")


def _ends_agree(edits: int, a: str, b: str, size: int) -> Column:
    """Whether ends of one length are at most twice as many edits apart as near lines, both together if no edit is in both."""
    most = 2 * allowed_edits(F.least("n", "n_v"), edits)
    head = F.levenshtein(F.substring(a, 1, size), F.substring(b, 1, size), 2 * edits)
    tail = F.levenshtein(F.right(a, F.lit(size)), F.right(b, F.lit(size)), 2 * edits)
    apart = F.least(F.char_length(a), F.char_length(b)) >= 2 * size + most
    return (head >= 0) & (head <= most) & (tail >= 0) & (tail <= most) & (~apart | (head + tail <= most))


def _trimmed(pairs: DataFrame) -> DataFrame:
    """Pairs ``(u, v, n, line, n_v, line_v)`` with ``mid`` and ``mid_v``: the lines without what they begin and end with in common.

    The distance stays the same. A character is left where one would become empty. Of very long lines some equal parts stay.
    """
    steps, least = F.array(*map(F.lit, STEPS)), F.least("n", "n_v")

    def longer(at, room):
        def step(have: Column, more: Column) -> Column:
            same = F.substring("line", at("n", have, more), more) == F.substring("line_v", at("n_v", have, more), more)
            return F.when((have + more <= room) & same, have + more).otherwise(have)

        return F.aggregate(steps, F.lit(0), step)

    rows = pairs.withColumn("before", longer(lambda n, have, more: have + 1, least))
    rows = rows.withColumn("behind", longer(lambda n, have, more: F.col(n) - have - more + 1, least - F.col("before")))
    rows = rows.withColumns(
        {
            "before": F.greatest(F.col("before") - 1, F.lit(0)),
            "behind": F.when(F.col("before") > 0, F.col("behind")).otherwise(F.greatest(F.col("behind") - 1, F.lit(0))),
        }
    )
    mid = [F.substring(c, F.col("before") + 1, F.col(n) - F.col("before") - F.col("behind")) for c, n in (("line", "n"), ("line_v", "n_v"))]
    return rows.select("u", "v", "n", "n_v", mid[0].alias("mid"), mid[1].alias("mid_v"))


def _linked(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs ``(u, v)`` of lines, each once, that are near; lines are bounded before characters are laid out."""
    most = allowed_edits(F.least("n", "n_v"), edits)
    close = _both(pairs, texts, "line").where(F.abs(F.col("n") - F.col("n_v")) <= most).where(_ends_agree(edits, "line", "line_v", ENDS))
    close = materialize(_trimmed(materialize(close, "close-pairs")), "trimmed-pairs").where(_ends_agree(edits, "mid", "mid_v", MID_ENDS))
    distance = F.levenshtein("mid", "mid_v", edits)
    bounded = materialize(close.where((distance >= 0) & (distance <= most)), "bounded-pairs")
    near = bounded.select("u", "v", "n", "n_v", F.split("mid", "").alias("chars"), F.split("mid_v", "").alias("chars_v"))
    near = near.where(edit_distance(F.col("chars"), F.col("chars_v"), edits) <= most)
    return materialize(near.select("u", "v"), "line-links")


def _with_cells(members: DataFrame, signed: DataFrame, component: DataFrame, edits: int) -> DataFrame:
    """``(u, v)``: lines under crowded keys that are not linked yet and can be near, compared in cells of bounded size.

    The keys of a line, at most the square of its places, are one row until they meet those of others.
    """
    under = F.collect_list(F.struct("key", "indexed", "m")).alias("under")
    rows = members.groupBy("lid").agg(under).join(component.withColumnRenamed("node", "lid"), "lid", "left")
    rows = materialize(rows.withColumn("component", F.coalesce("component", "lid")), "crowded-lines")
    by_key = rows.select("lid", "component", F.explode("under").alias("_under")).select("lid", "component", "_under.*")
    mixed = by_key.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("key")
    keys = F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.collect_set(F.when(F.col("indexed"), F.col("key")))).alias("own_keys")
    left = by_key.join(sized(materialize(mixed, "mixed-keys"), 24), "key").groupBy("lid", "component").agg(under, *keys)
    rows = materialize(left, "line-keys").join(signed, "lid").select("*", F.explode("under").alias("_under"))
    rows = rows.select("*", "_under.*").drop("under", "_under").withColumn("groups", F.ceil(F.col("m") / CELL).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("lid"), F.col("groups")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    index = _second(rows.where("indexed").select("key", "lid", "n", "half", *SIGNS, "component", "keys", "own_keys", F.col("own").alias("y"), every.alias("x")), "key", "x", "y")
    cells = rows.withColumnRenamed("own", "x").withColumn("y", every).join(index, ["key", "x", "y"])
    # Under the first of the keys that the two lines have in common.
    meet = F.least(F.array_min(F.array_intersect("keys", "own_keys_v")), F.array_min(F.array_intersect("own_keys", "keys_v")))
    new = cells.where("component != component_v AND (NOT indexed OR lid > lid_v)").where(_alike(edits)).where(F.col("key") == meet)
    return new.select(F.greatest("lid", "lid_v").alias("u"), F.least("lid", "lid_v").alias("v")).distinct()


def _near_links(lines: DataFrame, edits: int) -> DataFrame:
    """Links ``(u, v)`` that connect all of ``lines(lid, line, n)`` that single links of near lines connect."""
    keyed = _segment_keys(lines, edits)
    # Both counts in one sum: most keys have one line, and their rows are shuffled.
    both = F.sum(F.when(F.col("indexed"), (1 << 32) + 1).otherwise(1)).alias("both")
    found = keyed.groupBy("key").agg(both, F.min("lid").alias("a"), F.max("lid").alias("b")).where(f"both >= {1 << 32} AND a != b")
    found = materialize(found.select("key", F.col("both").bitwiseAND(F.lit((1 << 32) - 1)).alias("m"), "a", "b"), "segments")
    # Two lines under a key are a pair; more of them are looked up again.
    pairs = found.where("m = 2").select(F.col("b").alias("u"), F.col("a").alias("v"))
    members = materialize(keyed.join(sized(found.where("m > 2").select("key", "m"), 32), "key"), "segment-members")
    pairs = pairs.unionByName(_in_pairs(members.where(F.col("m") <= PAIRWISE), edits))
    many = members.where(F.col("m") > PAIRWISE).drop("m")
    wanted = members.select("lid").unionByName(found.where("m = 2").select(F.explode(F.array("a", "b")).alias("lid"))).distinct()
    texts = materialize(lines.join(sized(materialize(wanted, "wanted-lines"), 24), "lid"), "line-texts")
    further = materialize(_further_keys(many, texts, edits), "further-segments")
    own = F.when(F.col("indexed"), F.struct("lid", F.col("n").alias("n_v")))
    crowd = further.groupBy("key").agg(F.count("*").alias("m"), F.min(own).alias("v"))
    further = materialize(further.join(crowd.where("m > 1 AND v IS NOT NULL"), "key"), "further-members")
    crowded = further.where(F.col("m") > PAIRWISE)
    pairs = pairs.unionByName(_in_pairs(further.where(F.col("m") <= PAIRWISE), edits))
    # Of crowded keys first only one line with each of the others.
    star = crowded.select(F.col("lid").alias("u"), "n", F.col("v.lid").alias("v"), "v.n_v").where("u != v").where(_lengths_agree(edits)).select("u", "v")
    pairs = materialize(pairs.unionByName(star).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "line-pairs")
    links = _linked(pairs, texts, edits)
    if crowded.isEmpty():
        return links
    signed = materialize(_signed(texts.join(crowded.select("lid").distinct(), "lid")), "line-signs")
    first = materialize(connected_components(links), "first-components")
    left = _with_cells(crowded.drop("v", "n"), signed, first, edits)
    return links.unionByName(_linked(materialize(left, "cell-pairs"), texts, edits))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = THRESHOLD) -> DataFrame:
    """Removed lines: ``(doc_id, row, pos, near)``, every line of a class but its first one.

    Lines (between line feeds) with a word are in a class if they are equal, and those of at least ``NEAR_CHARS``
    characters also if near lines lead from one to the next: near are lines with at most ``edits`` (1 to 14) edits of one
    character between them, and at most one per ``NEAR_CHARS`` characters of the shorter one. The first line is the one with the smallest
    (document id, position), null ids last. ``near`` tells that the line differs from the class's first line.
    Lines of white space only are left alone. Null and empty texts have no such lines; repeated rows have the same
    lines as their first; a table without rows gives none. Other columns are ignored.
    """
    if not 1 <= edits <= 14:
        raise ValueError(f"edits must be 1 to 14, not {edits}")
    rows = line_rows(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos")
    two = [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]
    distinct = rows.groupBy(*two).agg(
        F.min(order).alias("first"), F.count("*").alias("n_rows"), F.first("line").alias("line")
    )
    lines = _written_zstd(
        distinct.select(
            F.monotonically_increasing_id().alias("lid"), "h1", "h2", "first", "n_rows", "line", F.char_length("line").alias("n")
        ).where((F.col("n") >= NEAR_CHARS) | (F.col("n_rows") > 1))
    )
    links = _near_links(lines.where(F.col("n") >= NEAR_CHARS).select("lid", "line", "n"), edits)
    component = materialize(connected_components(links), "line-components")
    classes = lines.select("lid", "h1", "h2", "first", "n_rows").join(component, F.col("node") == F.col("lid"), "left")
    classes = classes.withColumn("class", F.coalesce("component", "lid")).where("n_rows > 1 OR component IS NOT NULL")
    classes = materialize(classes.select("h1", "h2", "first", "class"), "line-classes")
    first = materialize(classes.groupBy("class").agg(F.min("first").alias("class_first")), "class-firsts")
    by_line = classes.join(first, "class").select("h1", "h2", "class_first", (F.col("first") != F.col("class_first")).alias("near"))
    by_line = materialize(by_line, "line-firsts")
    where = line_rows(docs, id_col, text_col).select("doc_id", "row", "pos", *two)
    marked = where.join(by_line, ["h1", "h2"])
    here = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos")
    return marked.where(~here.eqNullSafe(F.col("class_first"))).select("doc_id", "row", "pos", "near")


def _written_zstd(df: DataFrame) -> DataFrame:
    """Like ``materialize``, compressed harder: the table holds all distinct lines."""
    from lexigraft.session import scratch_path

    path = scratch_path(df.sparkSession, "lines")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with ``n_lines``, ``n_removed``, ``n_near`` and the text that is left, as ``kept_text``.

    See :func:`line_classes`. A null text stays null. The removed places of a document are gathered per document.
    """
    gone = line_classes(docs, id_col, text_col, edits).groupBy("doc_id", "row").agg(
        F.collect_set("pos").alias("gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("pos")))).cast("long").alias("n_near")
    )
    gone = materialize(gone.withColumnsRenamed({"doc_id": "_id", "row": "_row"}), "removed-lines")
    size = gone.agg(F.coalesce(F.sum(32 + 4 * F.size("gone")), F.lit(0)).alias("n")).first()["n"]
    side = F.broadcast(gone) if size <= (24 << 20) else gone
    joined = docs.join(side, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_row")), "left")
    lines = F.split(text_col, "\n")
    kept = F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    )
    return joined.select(
        *[docs[c] for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        kept.alias("kept_text"),
    )
