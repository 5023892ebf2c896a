"""Sequence packing, hard negatives and conversation repair against brute force."""

import functools
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigraft.llm import hard_negatives as hn
from lexigraft.llm.conversation_repair import repair_conversations, repaired_turns, solve, suffix_bounds
from lexigraft.llm.queries import damaged_conversations, op11_best_fit_packing, op12_hard_negatives, op13_conversation_repair
from lexigraft.llm.sequence_packing import PieceEncoder, best_fit, cut_lengths, pack_documents, pack_lengths, reduce_lengths

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = ("n", "key", "piece", "ids", "offset", "_id", "_part", "block", "pos", "group", "conv", "audit", "rank")


def with_extra(df):
    return df.selectExpr("*", *[f"cast(null as string) as `{c}`" for c in EXTRA if c not in df.columns])


# Packing


def fewest_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                k = rooms.index(room)
                place(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0] if items else 0


def naive_best_fit(items, capacity):
    rooms = []
    for item in sorted(items, reverse=True):
        fitting = [r for r in rooms if r >= item]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else capacity) - item)
    return sorted(rooms)


def unpacked(groups):
    return Counter({length: 0 for _, c in groups for length, _ in c}) + Counter(
        [length for bins, content in groups for length, each in content for _ in range(bins * each)]
    )


def as_counts(items, capacity):
    count = np.zeros(capacity + 1, np.int64)
    for x in items:
        count[x] += 1
    return count


def test_reduction_keeps_an_optimum():
    rng, fixed = random.Random(5), 0
    for _ in range(400):
        capacity = rng.choice([8, 20, 37])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        count = as_counts(items, capacity)
        groups = reduce_lengths(count, capacity)
        rest = [x for x in range(1, capacity + 1) for _ in range(count[x])]
        assert unpacked(groups) + Counter(rest) == Counter(items)
        assert all(sum(length * each for length, each in c) <= capacity for _, c in groups)
        assert sum(bins for bins, _ in groups) + fewest_bins(rest, capacity) == fewest_bins(items, capacity)
        fixed += sum(bins for bins, _ in groups)
    assert fixed > 500


def test_best_fit_by_lengths_equals_one_by_one():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([10, 31])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        groups = best_fit(as_counts(items, capacity), capacity)
        assert unpacked(groups) == Counter(items)
        rooms = sorted(capacity - sum(length * each for length, each in c) for bins, c in groups for _ in range(bins))
        assert rooms == naive_best_fit(items, capacity)


def test_many_pieces_are_packed_by_their_lengths():
    lengths = np.minimum(np.random.default_rng(0).lognormal(5.5, 1.0, 300_000).astype(int) + 1, 2048)
    groups = pack_lengths(dict(Counter(lengths.tolist())))
    assert unpacked(groups) == Counter(lengths.tolist())
    bins = sum(b for b, _ in groups)
    assert bins <= math.ceil(lengths.sum() / 2048) * 1.001
    with pytest.raises(ValueError, match="between"):
        pack_lengths({2049: 1})


def test_encoder_equals_the_library():
    encoder = PieceEncoder(open(BYTE_BPE, encoding="utf-8").read())
    exact = Tokenizer.from_file(BYTE_BPE)
    texts = ["", "Hello  world\r\n\t x", "<|endoftext|>a<|endoftext|", "naïve ½ 一二 　 \x1c 'S 'll", "a" * 5_000, " " * 5_000 + "b", "x y " * 60_000]
    assert encoder._fast is not None
    for t in texts:
        want = exact.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t).tolist() == want
        if t:
            assert encoder._fast.encode_to_numpy(t, allowed_special="all").tolist() == want


def check_packing(rows, got, capacity=2048):
    exact = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for i, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        n, first = cut_lengths(np.array([len(ids)]), capacity)
        start, length = 0, int(first[0])
        for piece in range(int(n[0])):
            part = np.array(ids[start : start + length], "<u4")
            want[i, piece, start, length, zlib.crc32(part.tobytes())] += 1
            start, length = start + length, capacity
        assert start == len(ids)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def digests(packed):
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()


def test_packing_of_odd_rows(documents):
    rows = [(1, "one two"), (2, None), (3, ""), (None, "null id " * 40), (None, "null id " * 40), (5, "long text, " * 9_000),
            (1, "one two"), (7, "w" * 30_000), (8, "é ü " * 2_000)] + [(k, "tie") for k in range(20, 60)]
    for capacity in (2048, 64):
        n = check_packing(rows, digests(pack_documents(documents(rows), BYTE_BPE, capacity)), capacity)
        assert n >= 1
    assert pack_documents(documents([]), BYTE_BPE).collect() == []


def test_packing_query(spark):
    got = op11_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    n = check_packing(rows, got)
    assert n <= 1 + math.ceil(sum(r.length for r in got) / 2048)


# Hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    """Rows are (id, label, vector)."""
    dims = max((len(v) for _, _, v in rows if v is not None), default=0)
    valid = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        valid.append((i, label, [math.floor(scale * x) for x in v] + [0] * (dims - len(v))))
    last = 1 << 70
    out = []
    for a, (anchor, label, q) in enumerate(valid):
        if not is_anchor(anchor):
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), last if i is None else i, other) for b, (i, other, p) in enumerate(valid) if b != a]
        scored.sort(key=lambda s: s[:2])
        for score, i, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and low * -score <= 100 * -s[0] <= high * -score]
            out += [(anchor, None if i == last else i, k + 1, None if j == last else j, -score, -s) for k, (s, j, _) in enumerate(found[:negatives])]
    return Counter(out)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def mined(spark, rows, is_anchor=None, **options):
    df = with_extra(spark.createDataFrame([(i, v, label) for i, label, v in rows], VECTORS))
    anchor = F.col("vec_id") % 10 == 0
    return Counter(tuple(r) for r in hn.mine_hard_negatives(df, anchor, **options).collect())


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(700):
        v = centres[i % 6] + rng.normal(size=12) * 0.4
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in v / np.linalg.norm(v)]))
    rows += [(9_000 + k, k % 3, rows[10][2]) for k in range(200)]  # one vector many times
    want = brute_negatives(rows, lambda i: i is not None and i % 10 == 0)
    assert want and mined(spark, rows) == want
    # Several groups of anchors.
    assert mined(spark, rows, group_bytes=4_000) == want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (10, 1, [0.9, 0.1]), (10, 1, [0.9, 0.1]), (10, 2, [0.9, 0.1]), (3, 1, [0.5, 0.5]), (4, 2, [0.9]),
            (5, 2, []), (6, None, [1.0, 0.0]), (7, 2, None), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (11, 2, [None, 1.0]),
            (None, 2, [0.95, 0.0]), (None, 1, [0.8, 0.2]), (20, 3, [-1.0, 0.0]), (30, 3, [-0.5, -0.5]), (40, 5, [0.0, 0.0]),
            (50, 5, [0.0, 0.0]), (60, -4, [3e4, -2e4]), (70, -4, [1e4, 1e3]), (71, 6, [1e4, 9e2])]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i is not None and i % 10 == 0)
    assert mined(spark, rows, positives=1, negatives=2, low=10) == brute_negatives(rows, lambda i: i is not None and i % 10 == 0, 1, 2, 10)


def test_negatives_of_little(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(0, 1, [1.0]), (1, 1, None)])
    assert not mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])])
    assert not mined(spark, [(0, 1, []), (10, 2, [])])
    rows = [(0, 1, []), (10, 1, []), (1, 2, [])]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i is not None and i % 10 == 0)
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, 1, [1e30]), (1, 1, [1e30])])


def test_bounds_hold_the_scores():
    rng = np.random.default_rng(4)
    for scale in (1, 256, 10_000):
        q = np.floor(scale * rng.normal(size=(200, 9)))
        q[:40] = q[0]
        q[40:50] = -q[0]
        q[50] = 0
        norms = np.linalg.norm(q, axis=1)
        references = hn.choose_references(q, 5)
        angles = hn.angles_to(q, norms, references)
        bottom, top = hn.score_bounds(angles, norms, angles, angles, norms, norms)
        scores = q @ q.T
        assert (bottom <= scores).all() and (scores <= top).all()


def test_filter_leaves_pairs_out():
    rng = np.random.default_rng(5)
    q = np.floor(256 * (np.repeat(np.eye(6), 50, axis=0) + rng.normal(size=(300, 6)) * 0.02))
    norms = np.linalg.norm(q, axis=1)
    angles = hn.angles_to(q, norms, hn.choose_references(q, 6))
    _, top = hn.score_bounds(angles, norms, angles, angles, norms, norms)
    assert (top < 0.5 * norms[:, None] * norms[None, :]).mean() > 0.7


def test_negatives_query(spark):
    rows = [
        (r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
        for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    ]
    got = Counter(tuple(r) for r in op12_hard_negatives(spark, "/root/testdata/sf0.001").collect())
    assert got == brute_negatives(rows, lambda i: i % 100 == 0)


# Conversations

WHITE = " \t\n\x0b\x0c\r"


def judged(messages):
    """Faults of (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in messages:
        bare = text.rstrip(WHITE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return faults


def cheapest(messages):
    """(cost, audit, repaired) by trying every edit of every message; inserts of up to two in a row."""
    faults = judged(messages)

    @functools.cache
    def rest(i, state):  # state: what the last kept role was
        options = []
        if i == len(messages):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = messages[i]
            c, audit, out = rest(i + 1, state)
            options.append((c + 2, "D" + audit, out))
            if faults[i] not in ("b", "d"):
                extra = 5 if faults[i] == "t" else 0
                for name, edit, cost in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    initial = name[:1]
                    if initial and ((state or "^") + initial) in ("^s", "^u", "su", "ua", "au"):
                        c, audit, out = rest(i + 1, initial)
                        options.append((c + cost + extra, edit + audit, ((name, text), *out)))
        for fresh in (("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
            last, good = state or "^", True
            for name in fresh:
                good = good and (last + name[0]) in ("^u", "su", "ua", "au")
                last = name[0]
            if good and (after := base(i, last)):
                c, audit, out = after
                options.append((c + 5 * len(fresh), "I" * len(fresh) + audit, (*((n, "") for n in fresh), *out)))
        return min(options, key=lambda o: o[:2])

    @functools.cache
    def base(i, state):
        """As ``rest`` without an insert at once."""
        if i == len(messages):
            return (0, "", ()) if state == "a" else None
        faults_i, (_, role, text) = faults[i], messages[i]
        c, audit, out = rest(i + 1, state)
        options = [(c + 2, "D" + audit, out)]
        if faults_i not in ("b", "d"):
            extra = 5 if faults_i == "t" else 0
            for name, edit, cost in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                if name[:1] and (state + name[:1]) in ("su", "ua", "au"):
                    c, audit, out = rest(i + 1, name[:1])
                    options.append((c + cost + extra, edit + audit, ((name, text), *out)))
        return min(options, key=lambda o: o[:2])

    return rest(0, "")


def brute_conversation(messages):
    if not messages:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    key = lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.md5(m[2].encode()).digest())
    messages = sorted(messages, key=key)
    turns = [t for t, _, _ in messages if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = Counter(judged(messages))
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(messages)]
    cost, audit, out = cheapest(messages)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, faults["b"], faults["d"], faults["t"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        out[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def as_codes(messages):
    role = {"s": 1, "u": 2, "a": 3}
    fault = {"": 0, "b": 4, "d": 4, "t": 8}
    return bytes(role.get(m[1][:1], 0) | fault[f] for m, f in zip(messages, judged(messages)))


def test_search_equals_trying_all():
    texts = ["Yes.", "No", "", "Why?"]
    roles = ["system", "user", "assistant", "tool"]
    for n in range(4):
        for messages in itertools.product(itertools.product([0], roles, texts), repeat=n):
            assert solve(as_codes(messages)) == cheapest(messages)[:2]
    rng = random.Random(8)
    for _ in range(300):
        messages = tuple((0, rng.choice(roles), rng.choice([*texts, f"Text {rng.random()}."])) for _ in range(rng.randint(4, 12)))
        assert solve(as_codes(messages)) == cheapest(messages)[:2]


def test_search_on_long_conversations():
    rng = random.Random(9)
    codes = bytes(rng.choice([0, 1, 2, 2, 3, 3, 6, 11]) for _ in range(60_000))
    cost, audit = solve(codes)
    assert cost == suffix_bounds(codes)[0] and len(audit.replace("I", "")) == len(codes)
    assert solve(bytes([2, 3] * 20_000)) == (0, "K" * 40_000)
    assert solve(bytes([3, 2] * 20_000))[0] < 10


def test_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 5, "user", "Hi."), (1, 6, "assistant", "cut off"),
        (2, None, "user", "Null turn."), (2, None, "user", "Another."), (2, 3, "assistant", "Yes.\t\n"),
        (3, 0, None, None), (3, 1, "", ""), (4, 0, "system", "Be good."),
        (None, 0, "user", "Null id?"), (None, 0, "user", "Null id?"), (None, 2, "assistant", "So what!"),
        (5, 1, "user", "Tie."), (5, 1, "assistant", "Tie."), (5, 1, "tool", "Tie."), (6, 0, "User", "Upper."), (7, None, None, None),
        (8, 0, "user", "long " * 100_000 + "."), (8, 1, "assistant", "end"),
    ] + [(9, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(500)] + [(10, 0, "user", "Same.")] * 300
    df = with_extra(spark.createDataFrame(rows, CONVERSATIONS))
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn, " " if role is None else role, " " if text is None else text))
    got = {r.conv_id: tuple(r[c] for c in RESULT) for r in repair_conversations(df).collect()}
    assert got == {conv: brute_conversation(messages) for conv, messages in grouped.items()}
    turns = defaultdict(list)
    for r in repaired_turns(df).collect():
        turns[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    for conv, values in got.items():
        assert hashlib.sha256("\n".join(t for _, t in sorted(turns[conv])).encode()).hexdigest() == values[-1]
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert repair_conversations(empty).collect() == [] and repaired_turns(empty).collect() == []


@pytest.mark.parametrize("odd", [False, True])
def test_repair_query(spark, tmp_path, odd):
    given = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{given}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    if odd:
        rng = random.Random(2)
        rows = [(rng.choice([r[0], r[0], None]), rng.choice([r[1], None, r[1] + 3]), rng.choice([r[2], None, "tool"]), rng.choice([r[3], None])) for r in rows]
        rows = list({r[:2]: r for r in rows}.values()) + [(1_000 + k, k, "user", "Gone?") for k in range(60)]
        spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
        given = str(tmp_path)
    got = {r.conv_id: tuple(r[c] for c in RESULT) for r in op13_conversation_repair(spark, given).collect()}
    want = {conv: brute_conversation(messages) for conv, messages in damage(rows).items()}
    assert got == want
    assert any(not messages for messages in damage(rows).values()) or not odd
    assert damaged_conversations(spark.createDataFrame([], CONVERSATIONS)).count() == 0
