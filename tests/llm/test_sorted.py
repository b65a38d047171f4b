"""The operators over sorted rows, each against brute force: running sums, the conversation trie, mixing, spelling."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouch.llm import mixing, queries, spelling, trie
from vouch.llm.scans import scan


class TestScan:
    def test_by_loops(self, spark):
        """One key has half of all rows, and ranges are many: sums and heads go on over them."""
        rng = random.Random(1)
        rows = [(rng.choice("aaaabc"), rng.choice([0, 1]), i, rng.randrange(-5, 99), rng.random()) for i in range(4000)]
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        try:
            frame = spark.createDataFrame(rows, "k string, l long, i long, v long, d double")
            found = {r.i: (r.sum_v, r.head_d, r.head_i) for r in scan(frame, ["k", "l"], ["i"], ["v"], ["d", "i"]).collect()}
            whole = {r.i: r.sum_v for r in scan(frame, [], ["i"], ["v"]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "3")
        sums, heads, total = Counter(), {}, 0
        for k, part, i, v, d in rows:
            sums[k, part] += v
            total += v
            heads.setdefault((k, part), (d, i))
            assert found[i] == (sums[k, part], *heads[k, part]) and whole[i] == total

    def test_empty(self, spark):
        assert scan(spark.createDataFrame([], "k string, v long"), ["k"], ["v"], ["v"]).count() == 0


class TestListRanks:
    @pytest.mark.parametrize("near", [True, False])
    def test_by_walking(self, spark, near):
        """Lists in the order of their ids and in no order at all, over ranges of few arcs, so that rulers are needed too."""
        order = list(range(3000))
        if not near:
            random.Random(2).shuffle(order)
        arcs = [(a, b) for a, b in zip(order, [*order[1:], None])]
        ranks = dict(map(tuple, trie.list_ranks(spark.createDataFrame(arcs, "id long, next long"), most=100).collect()))
        assert ranks == {a: len(order) - i for i, a in enumerate(order)}


def trie_by_loops(talks):
    """Nodes from {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(seq[:-1] for seq in members if seq)
    leaves, saved = Counter(), Counter()
    for seq, who in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not kids[seq]
            saved[seq[:d]] += (len(who) - 1) * len(seq[-1][1]) if seq else 0
    out = set()
    for seq, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(talks[c]) == len(seq))
        out.add((min(who), len(seq), min(members[seq[:-1]]) if seq else None, len(who), kids[seq], leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(seed, n):
    """Conversations of few different turns, with null and tied turns, nulls, repeated rows and one long conversation."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for i in range(rng.randrange(1, 9)):
            rows.append((c if c % 3 else c + 100, rng.choice([i, i, i, None, 1]), rng.choice(["user", "bot", None]), rng.choice(["é", "ab", "abc", "", None]), "x"))
    rows += [(7, i, "user", f"turn {i % 3}", "y") for i in range(300)]
    rows += rows[:20] + [(None, 1, "user", "lost", "z"), (-5, None, None, None, None)]
    return rows


def ordered(rows):
    talks = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(them)] for c, them in talks.items()}


def rebuilt_by_loops(talks):
    """As the query has it; the remainder is that of SQL, towards zero."""
    out = {}
    for c, own in talks.items():
        h, head = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        out[c] = talks.get(head, [])[:h] + own[h:]
    return out


class TestTrie:
    SCHEMA = "conv_id long, turn long, role string, text string, depth string"

    @pytest.mark.parametrize("seed, most", [(1, 1 << 17), (2, 64)])
    def test_by_loops(self, spark, seed, most):
        rows = rows_of(seed, 150)
        turns = trie.numbered_turns(spark.createDataFrame(rows, self.SCHEMA)).withColumnRenamed("pos", "depth")
        nodes = trie.prefix_trie(turns, turns.select("conv_id").distinct(), most).cache()
        found = [tuple(r) for r in nodes.select(NODE).collect()]
        assert len(found) == len(set(found)) and set(found) == trie_by_loops(ordered(rows))
        # A subtree is what enters between its top's places.
        spans = {(r.conv_id, r.depth): (r.enter_at, r.leave_at) for r in nodes.collect()}
        assert sorted(x for s in spans.values() for x in s) == list(range(2 * len(spans)))
        for r in nodes.filter("depth > 0").collect():
            a, b = spans[r.parent_conv_id, r.depth - 1]
            assert a < r.enter_at < r.leave_at < b

    def test_query(self, spark, tmp_path):
        """The query's rebuilt conversations: heads, conversations without one, and those without a turn."""
        rows = rows_of(3, 320)
        spark.createDataFrame(rows, self.SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
        found = [tuple(r) for r in queries.op11_prefix_trie(spark, str(tmp_path)).select(NODE).collect()]
        talks = rebuilt_by_loops(ordered(rows))
        assert [] in talks.values()
        assert len(found) == len(set(found)) and set(found) == trie_by_loops(talks)

    def test_chunks(self, spark, monkeypatch):
        """Many members that end at one node are hashed chunk by chunk."""
        monkeypatch.setattr(trie, "CHUNK", 7)
        rows = [(c, 0, "user", "same", None) for c in range(1000)] + [(c, 1, "user", "more", None) for c in range(1, 1000, 2)]
        turns = trie.numbered_turns(spark.createDataFrame(rows, self.SCHEMA)).withColumnRenamed("pos", "depth")
        found = {tuple(r) for r in trie.prefix_trie(turns, turns.select("conv_id").distinct()).select(NODE).collect()}
        assert found == trie_by_loops(ordered(rows))

    def test_roles_and_texts_apart(self, spark):
        rows = [(1, 0, "user\nx", "y", None), (2, 0, "user", "x\ny", None), (3, 0, "user", "x\ny", None)]
        turns = trie.numbered_turns(spark.createDataFrame(rows, self.SCHEMA)).withColumnRenamed("pos", "depth")
        found = {tuple(r) for r in trie.prefix_trie(turns, turns.select("conv_id").distinct()).select(NODE).collect()}
        assert found == trie_by_loops(ordered(rows)) and len(found) == 3

    def test_clash(self, spark):
        steps = spark.createDataFrame([(1, 1, b"a", 3, b"0", b"p"), (2, 1, b"b", 3, b"0", b"p")], "conv_id long, depth long, said binary, size long, before binary, prefix binary")
        with pytest.raises(Exception, match="same prefix hash"):
            trie.trie_nodes(steps, steps.select("conv_id")).collect()

    def test_empty(self, spark):
        turns = trie.numbered_turns(spark.createDataFrame([], self.SCHEMA)).withColumnRenamed("pos", "depth")
        assert trie.prefix_trie(turns, turns.select("conv_id")).count() == 0


def targets_by_loops(sizes, weights=(3, 1, 2), share=1.5, readings=2):
    """sizes by source (None last): words are shared by weight, again and again, until no source is above its most."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > readings * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        for s in over:
            fixed[s] = readings * sizes[s]
            left -= fixed[s]


class TestMix:
    SCHEMA = "doc_id long, text string, source string, size string, target string"

    def rows(self, seed):
        rng = random.Random(seed)
        source = lambda: rng.choice(["hot"] * 9 + ["a", "b", "é", "B", "", None])
        rows = [(i, " ".join(["w\tx"] * rng.randrange(0, 40)), source(), "s", None) for i in range(500)]
        return rows + rows[:5] + [(None, "one two", None, None, None), (None, "one two", None, None, None), (900, None, "a", None, None), (901, "  ", "none", None, None), (902, "w " * 3000, "big", None, None)]

    @pytest.mark.parametrize("seed", [1, 2])
    def test_by_loops(self, spark, seed):
        rows = self.rows(seed)
        words = [len((t or "").split()) for _, t, *_ in rows]
        sizes = Counter()
        for (_, _, s, *_), n in zip(rows, words):
            sizes[s] += n
        due = targets_by_loops(sizes)
        mixed = mixing.mix(spark.createDataFrame(rows, self.SCHEMA)).collect()
        first = [r for r in mixed if r.reading == 0]
        assert Counter((r.doc_id, r.size, r.source_size) for r in first) == Counter((i, n, sizes[s]) for (i, _, s, *_), n in zip(rows, words))
        taken = Counter()
        for r in mixed:
            name = r.source if r.named else None
            assert r.target == pytest.approx(due[name]) and 0 <= r.taken <= r.size
            taken[name] += r.taken
        # Each source is served its target, but for less than a word.
        assert all(due[s] - 1 - 1e-6 <= taken[s] <= due[s] + 1e-6 for s in sizes)
        # The mix is one sequence of words without a gap.
        spots = sorted((r.upto - r.taken, r.upto) for r in mixed if r.taken)
        assert spots[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spots, spots[1:])) and spots[-1][1] <= 1.5 * sum(words)
        # At any time of the mix every source has had its share, but for the document in service.
        had, most = Counter(), max(words)
        total = sum(taken.values())
        for r in sorted((r for r in mixed if r.taken), key=lambda r: r.upto):
            name = r.source if r.named else None
            had[name] += r.taken
            assert had[name] <= due[name] * r.upto / total + (len(sizes) + 1) * most

    def test_reruns_agree(self, spark):
        rows = self.rows(3)
        told = lambda: Counter(map(tuple, mixing.taken_words(spark.createDataFrame(rows, self.SCHEMA)).collect()))
        once = told()
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        random.Random(4).shuffle(rows)
        try:
            assert told() == once and sum(once.values()) == len(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "3")

    def test_odd_and_empty(self, spark, odd, none):
        docs = odd.withColumn("source", F.col("key"))
        assert mixing.taken_words(docs).count() == odd.count()
        assert mixing.taken_words(none.withColumn("source", F.col("key"))).count() == 0
        wordless = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
        assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.taken_words(wordless).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms_by_loops(docs, letters, often, slips, ratio):
    """The contract, word by word and pair by pair."""
    n = Counter()
    for doc, text in docs:
        run = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch < "a" else ch
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % slips == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
                if len(run) >= letters:
                    n[run] += 1
                run = ""
    n = {w: k for w, k in n.items() if k >= often}
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= ratio * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


class TestSpelling:
    def test_ranges(self):
        """Every pair of a list is found once, over several cells."""
        rng = random.Random(5)
        words = sorted({"".join(rng.choice("abç") for _ in range(rng.randrange(0, 8))) for _ in range(400)})
        cells = np.repeat([0, 1], len(words))
        lists, found = spelling.Lists(cells, words + words), Counter()
        for q, s in lists.near(np.arange(2 * len(words))):
            assert ((q < len(words)) == (s < len(words))).all()
            found.update(zip((q % len(words)).tolist(), (s % len(words)).tolist()))
        assert found == Counter({(i, j): 2 for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)})

    @pytest.mark.parametrize("most", [2, 20, 4096])
    def test_pairs(self, spark, most):
        """Cells that are split down to the letter give the same pairs, each once."""
        rng = random.Random(6)
        words = sorted({"".join(rng.choice("aab") for _ in range(rng.randrange(5, 11))) for _ in range(300)} | {"x" * 40 + a for a in "abcdef"} | {"x" * 39 + a for a in "abç"})
        frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
        found = Counter(map(tuple, spelling.near_pairs(frame, most=most).collect()))
        assert found == Counter((a, i, b, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b))

    @pytest.mark.parametrize("most", [5, 4096])
    def test_by_loops(self, spark, most):
        rng = random.Random(7)
        text = lambda: " ".join("".join(rng.choice("aAbé×") for _ in range(min(7, max(1, round(rng.gauss(5, 1)))))) for _ in range(rng.randrange(120)))
        docs = [(i, text()) for i in range(60)]
        docs += docs[:3] + [(None, "alone alone alone alonE"), (70, None), (71, ""), (72, "Straße-straße_straßE3straßen ſtrasse Āstraßen")]
        frame = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int")
        found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_forms(frame, slips=7, most=most).collect()}
        expected = forms_by_loops(docs, 5, 3, 7, 2)
        assert found == expected and any(r[1] != (r[0] or w) for w, r in expected.items())

    def test_long_texts(self, spark, monkeypatch):
        """A text is searched stretch by stretch without cutting a run or a code point."""
        text = "étéété été straße " * 500 + "long" * 2000
        whole = Counter(spelling.RUN.findall(text.encode().lower()))
        for stretch in (1, 7, 64, 1000):
            monkeypatch.setattr(spelling, "STRETCH", stretch)
            assert spelling.runs_of(text.encode()) == whole
        monkeypatch.setattr(spelling, "STRETCH", 1000)
        found = spelling.variant_forms(spark.createDataFrame([(i, "a" * 3000 + " " + "a" * 2999) for i in range(4)], "doc_id long, text string"), slips=10**9).collect()
        assert {(len(r.word), r.n, r.n_near) for r in found} == {(3000, 4, 1), (2999, 4, 1)}

    def test_empty(self, none):
        assert spelling.variant_forms(none).count() == 0
