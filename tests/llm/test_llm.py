"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import components, decontamination, exact_dedup, language_id, license_texts, licenses, minhash, mixing, quality, repeats, sharding, token_counts
from veilspark.plans.packaging import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, k long, size long"
WORDS = [a + b + c for a in ("ta", "re", "mo", "li", "su") for b in ("na", "ke", "vi", "po") for c in ("r", "s", "n", "l")]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    r = random.Random(1)
    base = sentence(r, 120)
    texts = [None, "", "   \n", "one", "two words", "x" * 5000, sentence(r, 3000), base, base, base.replace(" ", "\n"), base.upper(), "ñandú été straße 日本語 " * 30]
    for _ in range(40):  # near copies, from hardly to much changed
        w = base.split()
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    for _ in range(40):
        texts.append(sentence(r, r.randint(1, 300)) + " " + base[100:420])
    texts += [sentence(r, 200) for _ in range(30)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["b", "a", None]), 0, 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[20]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(t, n):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("like", [minhash.Similarity(3, 85, 100), minhash.Similarity()])
def test_near_groups(docs, empty, like):
    own = {d[0]: shingles(d[1], like.words) for d in corpus()}
    group = {i: i for i in own}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(own)
    for x in ids:
        for y in ids:
            inter = len(own[x] & own[y])
            if x < y and inter and inter * like.den >= like.num * len(own[x] | own[y]):
                a, b = sorted((root(x), root(y)))
                group[b] = a
    rows = minhash.near_groups(docs, like).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(own[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert minhash.near_groups(empty, like).isEmpty()


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(r.randint(100, 180), r.randint(100, 180)) for _ in range(60)] + [(500, i) for i in range(501, 620)]
    found = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    group = {}
    for a, b in links:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        if group[a] is not group[b]:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    assert found == {x: min(g) for x, g in group.items() if len(g) > 1}


def test_repeats(docs, empty):
    rows = corpus()
    data = [(d[1] or "").encode() for d in rows]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    want = Counter()
    for d, b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        want[d[0], len(b), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs).collect())
    assert got == want
    assert repeats.without_repeats(empty).isEmpty()


def test_decontamination(spark, docs, empty):
    r = random.Random(9)
    items = [sentence(r, n) + ". " + sentence(r, 8) + "." for n in (12, 30, 70, 150)]
    changed = items[2].split()
    for i in range(0, len(changed), 9):
        changed[i] = "otro"
    planted = [(1000 + i, sentence(r, 100) + "\n" + t + " " + sentence(r, 90)) for i, t in enumerate([*[x.upper() for x in items], " ".join(changed)])]
    clean = [(2000 + i, sentence(r, 150)) for i in range(60)]
    table = spark.createDataFrame([*planted, *clean, (1, None), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontamination.contaminated(table, bench).collect()}
    assert found == {(1000 + i, i) for i in range(4)} | {(1004, 2)}
    assert {x.doc_id for x in decontamination.without_contaminated(table, bench).collect()} == {d for d, _ in clean} | {1, 2}
    assert decontamination.contaminated(empty, bench).isEmpty()
    assert decontamination.contaminated(table, bench.where("false")).isEmpty()


def test_decontamination_with_rare_words_replaced(spark):
    """Three quarters of an item's words in order, though 11 of its 18 rare words are others."""
    common, rare = [f"fun{i}" for i in range(15)], [f"rara{i}" for i in range(18)]
    item = [w for i in range(6) for w in (*rare[3 * i : 3 * i + 3], *(common[(5 * i + j) % 15] for j in range(5)))]
    kept = ["otra" if w in rare[:11] else w for w in item]
    far = ["otra" if w in rare[:13] else w for w in item]
    rows = [(i, " ".join(common) + " nada") for i in range(60)] + [(100, " ".join(kept)), (101, " ".join(far))] + [(200 + i, " ".join(item)) for i in range(3)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {x.doc_id: x.share for x in found} == {100: 37 / 48, 200: 1.0, 201: 1.0, 202: 1.0}


def test_decontamination_of_hot_items(spark):
    """Verbatim copies of an item that stands in most texts, amid words of other items."""
    r = random.Random(5)
    hot = " ".join(f"caliente{i}" for i in range(40))
    other = [" ".join(f"frio{j}x{i}" for i in range(40)) for j in range(6)]
    mixed = [w for t in other for w in t.split()]
    rows = []
    for i in range(120):
        a, b = (" ".join(r.sample(mixed, 40)) for _ in range(2))
        rows.append((i, f"{a} {hot} {b}"))
    rows += [(1000 + i, " ".join(r.sample(mixed, 80))) for i in range(60)]
    bench = spark.createDataFrame([*enumerate([hot, *other])], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {(i, 0) for i in range(120)}


def test_reworded_items_equal_exhaustive_search(spark):
    """Items with more and more words replaced by others of the corpus: what the candidate search finds, against the longest common
    subsequence of every item with every place of every text."""
    r = random.Random(21)
    vocabulary = [a + b for a in WORDS for b in WORDS[:12]]
    weight = [1 / (i + 3) for i in range(len(vocabulary))]
    prose = lambda n: r.choices(vocabulary, weight, k=n)
    items = [prose(r.randint(25, 120)) for _ in range(40)]
    rows = [(i, " ".join(prose(r.randint(20, 200)))) for i in range(200)]
    for i in range(240):
        w = [x if r.random() > (i % 8) / 20 else r.choice(prose(1)) for x in items[i % 40]]
        rows.append((1000 + i, " ".join([*prose(60), *w, *prose(60)])))
    numbers = {w: i for i, w in enumerate(vocabulary)}
    number = lambda t: np.array([numbers[w] for w in t])
    due = set()
    for d, text in rows:
        ids = number(text.split())
        for k, item in enumerate(items):
            n = 0
            for part in np.array_split(number(item), max(1, -(-len(item) // decontamination.PASSAGE))):
                n += max(decontamination.lcs(part, ids[x : x + 2 * len(part)]) for x in range(0, len(ids), max(1, len(part) // 2)))
            if n / len(item) >= decontamination.SHARE:
                due.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = {(x.doc_id, x.item_id): x.share for x in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    reworded = {x for x in due if x[0] >= 1000}
    assert len(reworded) > 150 and len(reworded & set(found)) >= 0.9 * len(reworded)
    assert all(share >= decontamination.SHARE_WITH_ANSWER for share in found.values()) and not {x for x in found if x[0] < 1000 and x not in due}


def test_lcs():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randint(-1, 5) for _ in range(r.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y and x >= 0 else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.lcs(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_language_id(spark, empty):
    r = random.Random(3)
    made = {"aa": [w for w in WORDS if w[0] in "tr"], "bb": [w for w in WORDS if w[0] in "ml"]}
    rows = [(i, " ".join(r.choice(made[lang]) for _ in range(40)), lang) for i in range(200) for lang in [r.choice(["aa", "bb"])]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table)
    test = spark.createDataFrame([(1, "tanart tanares TANAR"), (2, "molinol likes"), (3, None), (4, "123 ... "), (5, ""), (5, "")], "doc_id long, text string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.detect(test, model).collect()}
    assert got[1][0] == "aa" and got[2][0] == "bb" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert all(x.lang_pred == y for x, (_, _, y) in zip(language_id.detect(table, model).orderBy("doc_id").collect(), rows, strict=True))
    assert language_id.detect(test, language_id.fit(empty)).where("lang_pred <> 'und'").isEmpty()
    assert language_id.detect(empty, model).isEmpty()


def thue_morse(n):
    """Two words over two letters on which polynomial hashes modulo a power of two agree."""
    w = "1"
    while len(w) < n:
        w += w.translate({49: 97, 97: 49})
    return w, w.translate({49: 97, 97: 49})


def test_token_counts(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b I'LL 12 é!!", "<|startoftext|>", "ΟΔΥΣΣΕΥΣ ΣΑΣ\u00a0a\u2003b", "e\u0301 \u0301x", *thue_morse(1024), *thue_morse(2048), "x " * 5000 + "y" * 70000, "\u2028\x1c\x85 z"]
    rows = spark.createDataFrame([(1000 + i, t, None, None, 0, 0, 0, 0) for i, t in enumerate(odd)], DOCS)
    texts = {d[0]: d[1] or "" for d in corpus()} | {1000 + i: t for i, t in enumerate(odd)}
    want = sorted((d, len(texts[d].encode()), n, n > 2048) for d in [*(x[0] for x in corpus()), *range(1000, 1000 + len(odd))] for n in [len(whole.encode(texts[d], add_special_tokens=False))])
    for hot in (token_counts.HOT_RUNS, 3):
        assert sorted(map(tuple, token_counts.token_counts(docs.unionByName(rows), hot_runs=hot).collect())) == want
    assert token_counts.token_counts(empty).isEmpty()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizers_that_keep_white_space(spark, name):
    texts = ["  two  spaces\n\nline ", "", None, "a b"]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    lengths = token_counts.piece_lengths(name)
    assert not token_counts.drops_space(name) and token_counts.drops_space("word_bpe_49k.json")
    assert {x.doc_id: x.n_tokens for x in token_counts.token_counts(rows, name).collect()} == {i: lengths([t or ""])[0] for i, t in enumerate(texts)}


def test_hashes_tell_words_apart():
    from veilspark.llm import textops as T

    for n in (1024, 2048):
        data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
        for family in (0, 1):
            h = T.span_hash(T.prefix_hash(data, family), np.array([0, n]), np.array([n, 2 * n]))
            assert h[0] != h[1]
    r = np.random.default_rng(5)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    data[3000:3500] = data[100:600]
    for values in (data, data.astype(np.uint32) * 4096):
        p = T.prefix_hash(values)
        assert T.span_hash(p, np.array([100]), np.array([600])) == T.span_hash(p, np.array([3000]), np.array([3500]))
    for size in (1, 2, 7, 100):
        h = T.sampling_hash(data, size)
        assert len(h) == 5001 - size and h[100] == h[3000] and len(np.unique(h)) >= len({data[i : i + size].tobytes() for i in range(5001 - size)})


def test_words_of_equal_polynomials(spark):
    """op1 does not link, and op2 does not remove, what only a hash modulo a power of two takes for equal."""
    texts = [*thue_morse(1024), *thue_morse(2048)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {(x.doc_id, x.component_id) for x in minhash.near_groups(docs).collect()} == {(i, i) for i in range(4)}
    model = language_id.fit(spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)] * 3, "doc_id long, text string, lang string"))
    assert len(model.languages) == 2 or not model.languages
    data = [t.encode() for t in texts]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    for x in repeats.without_repeats(docs).collect():
        b, gone = data[x.doc_id], set()
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        assert x.n_removed == len(gone)


def test_one_key_with_different_texts(spark):
    """Rows of one key are linked by their own texts, and each row comes once."""
    r = random.Random(11)
    a, b, c = (sentence(r, 80) for _ in range(3))
    rows = [(1, a), (1, b), (2, b + " fin"), (3, a), (None, c), (None, c), (4, c), (None, "solo uno dos tres cuatro cinco"), (5, None), (5, "")]
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0, x.kept) for x in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    size = lambda t: len(shingles(t, 5))
    want = [(1, size(a), 1, True), (1, size(b), 1, True), (2, size(b + " fin"), 1, False), (3, size(a), 1, False), (0, size(c), 4, False), (0, size(c), 4, False), (4, size(c), 4, True), (0, 2, 0, True), (5, 0, 5, True), (5, 0, 5, True)]
    assert got == sorted(want)


def test_boilerplate_that_is_alike_but_not_linked(spark):
    """Many texts over the banding's reach but under the threshold, with some links across: no link is lost."""
    r = random.Random(12)
    base = sentence(r, 100).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for x in range(0, 100, 12):
            w[x] = r.choice(WORDS) + r.choice(WORDS)
        texts.append(w)
    for i in range(0, 60, 7):
        w = list(texts[i])
        w[50] = "otro"
        texts.append(w)
    like = minhash.Similarity(3, 85, 100)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    own = {i: shingles(t, 3) for i, t in rows}
    group = {i: {i} for i in own}
    for i in own:
        for j in own:
            if i < j and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j]) and group[i] is not group[j]:
                both = group[i] | group[j]
                group.update(dict.fromkeys(both, both))
    assert {x.doc_id: x.component_id for x in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()} == {i: min(g) for i, g in group.items()}
    # the step for what the rounds leave, alone: every member a component of its own
    member = spark.createDataFrame([(i, len(own[i]), i) for i in own], "c long, n long, component long")
    sets = minhash.shingle_sets(spark.createDataFrame(rows, "c long, text string"), like)
    pairs = minhash._verified(minhash._crossing_pairs(member, sets, like), sets, like).collect()
    assert {(x.a, x.b) for x in pairs} == {(i, j) for i in own for j in own if i < j and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])}


@pytest.mark.parametrize("most", [0, 4000, 1 << 17])
def test_components_in_one_task_and_by_steps(spark, monkeypatch, most):
    """A small table goes to one task, in one job after its count; chains, hubs, loops and repeated links give the same either way."""
    monkeypatch.setattr(components, "LOCAL_LINKS", most)
    r = random.Random(5)
    links = [(i, i + 1) for i in range(100, 400)] + [(-7, i) for i in range(1000, 1900)] + [(i, i) for i in range(40)]
    links += [(r.randrange(5000, 9000), r.randrange(5000, 9000)) for _ in range(1500)] * 2
    group = {}
    for a, b in links:
        if a != b:
            both = group.get(a, {a}) | group.get(b, {b})
            group.update(dict.fromkeys(both, both))
    table = spark.createDataFrame(links, "a long, b long").repartition(7)
    found = components.components(table, "a", "b").collect()
    assert sorted((x.node, x.component) for x in found) == sorted((i, min(g)) for i, g in group.items())
    assert components.components(table.where("a = b"), "a", "b").isEmpty()
    words = components.components(spark.createDataFrame([("b", "a"), ("b", "c")], "a string, b string"), "a", "b").collect()
    assert sorted((x.node, x.component) for x in words) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_star_rounds_compare_no_members_of_one_component(spark):
    """A later round pairs a bucket's members with its centre only where their components differ."""
    member = spark.createDataFrame([(c, 9, b) for b, own in {1: range(6), 2: (0, 1, 2), 3: (4, 5)}.items() for c in own], "c long, n long, bucket long")
    comp = spark.createDataFrame([(c, c - c % 3) for c in range(5)], "node long, component long")  # 5 is in no link so far
    own = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    for turn in (1, 2):
        pairs = [(x.a, x.b) for x in minhash._stars(member, comp, turn).collect()]
        assert pairs and all(own[a] != own[b] for a, b in pairs) and len(set(pairs)) == len(pairs)


def targets_by_turns(sizes, weights, budget, most=3):
    """Targets by filling the sources that are over ``most`` times their size, turn by turn."""
    target, free, left = dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s] > 0}, float(budget)
    while free:
        share = left / sum(weights[s] for s in free)
        full = {s for s in free if share * weights[s] > most * sizes[s]}
        if not full:
            return target | {s: share * weights[s] for s in free}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target


def cyclic_weights(sources):
    return {s: 1.0 + i % 3 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def queue_by_hand(narrow, share=1.0):
    """(k, s, size, copies) of every row: all copies in one list in order of finish time, taken until the budget is reached."""
    sizes = Counter()
    for r in narrow:
        sizes[r.s] += r.size
    target = targets_by_turns(dict(sizes), cyclic_weights(sizes), share * sum(sizes.values()))
    place = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    copies = []
    none = lambda x: (x is not None, x or 0)
    for s in sizes:
        end = 0
        for i, r in enumerate(sorted((r for r in narrow if r.s == s), key=lambda r: (r.h, none(r.k), r.size, none(r.th)))):
            end += r.size
            copies += [((p * sizes[s] + end) / target[s], place[s], p, i, r) for p in range(3) if r.size and target[s]]
    taken, left = Counter(), share * sum(sizes.values())
    for *_, r in sorted(copies, key=lambda c: c[:4]):
        if r.size > left:
            break
        left -= r.size
        taken[r.id] += 1
    return Counter((r.k, r.s, r.size, taken[r.id]) for r in narrow), target


def narrow_rows(docs):
    return docs.select(F.monotonically_increasing_id().alias("id"), *mixing._rows(F.col("doc_id"), F.col("source"), F.col("text"), 42)).collect()


@pytest.mark.parametrize("share", [1.0, 0.3])
def test_mixing(docs, empty, share):
    want, target = queue_by_hand(narrow_rows(docs), share)
    rows = mixing.fair_queue(docs, budget_share=share).collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in rows) == want
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.taken == r.copies * r.size for r in rows)
    again = mixing.fair_queue(docs.repartition(7), budget_share=share).collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in again) == want
    assert mixing.fair_queue(empty).isEmpty()


def test_mixing_with_null_and_repeated_keys(spark):
    """Every row stands in the mix as often as its row of the queue says, though keys are null or repeat; reruns agree."""
    r = random.Random(3)
    rows = [(i, sentence(r, 20 + i), "ab"[i % 2], i) for i in range(20)]
    rows += [(None, sentence(r, 33), "a", 1), (None, sentence(r, 34), None, 2), (None, sentence(r, 34), None, 3), (5, sentence(r, 41), "a", 4), (5, sentence(r, 12), "b", 5), (5, sentence(r, 43), "b", 6), (7, None, "a", 7), (8, "x y z", "c", 8)]
    rows += [(9, "igual " * 30, "a", 9)] * 12
    schema = "doc_id long, text string, source string, _k int"
    table = spark.createDataFrame(rows, schema).repartition(4)
    want, _ = queue_by_hand(narrow_rows(table))
    due = Counter()
    for (k, s, size, copies), n in want.items():
        due[k, s, size] += copies * n
    for own in (table, table.repartition(3)):
        out = mixing.mixed_documents(own)
        assert out.columns == own.columns
        assert Counter((d.doc_id, d.source, len(words(d.text))) for d in out.collect()) == +due
    assert Counter((q.doc_id, q.source, q.size, q.copies) for q in mixing.fair_queue(table.drop("_k")).collect()) == want


def test_targets_reshare(spark):
    r = random.Random(2)
    for _ in range(6):
        sizes = {f"s{i}": r.choice([0, 1, 10, 100, 1000, 10000]) * r.randint(1, 9) for i in range(r.randint(1, 9))}
        weights = {s: float(r.randint(1, 5)) for s in sizes}
        budget = r.choice([0.5, 1.0, 3.0, 5.0]) * sum(sizes.values())
        table = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "tag string, size long, weight double")
        got = {x.tag: x.target for x in mixing.source_targets(table, budget).collect()}
        assert got == pytest.approx(targets_by_turns(sizes, weights, budget))


def test_shards(docs, empty):
    limit = 20000
    rows = sharding.shards(docs, limit).collect()
    assert len(rows) == len(corpus())
    bits = {r.doc_id: format(r.h & (1 << 64) - 1, "064b") for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    sizes = Counter()
    for d in corpus():
        sizes[bits[d[0]]] += len((d[1] or "").encode())

    def leaf(key, depth=0):
        inside = {b: n for b, n in sizes.items() if b[:depth] == key[:depth]}
        return key[:depth] if sum(inside.values()) <= limit or len(inside) == 1 else leaf(key, depth + 1)

    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.oversized or r.shard == leaf(bits[r.doc_id])
        assert bits[r.doc_id].startswith(r.shard) and r.depth == len(r.shard)
    assert len(by) > 4
    for shard, own in by.items():
        assert sum(r.n_bytes for r in own) == own[0].shard_bytes and len(own) == own[0].shard_docs
        assert own[0].shard_bytes <= limit or (own[0].oversized and len({r.doc_id for r in own}) == 1)
        assert not any(o != shard and o.startswith(shard) for o in by)
        parent = [r for r in rows if r.shard.startswith(shard[:-1])]
        assert not shard or own[0].oversized or sum(r.n_bytes for r in parent) > limit
    assert len({r.doc_id for r in rows}) == len({(r.doc_id, r.shard) for r in rows})
    assert sharding.shards(docs, 1 << 30).select("shard").distinct().collect()[0][0] == ""
    assert sharding.shards(empty, limit).isEmpty()


def test_quality(spark, empty):
    r = random.Random(6)
    rows = [(i, sentence(r, 60) if i % 2 else re.sub(" ", "&&& ", sentence(r, 60)) if i % 4 else " ".join([r.choice(WORDS)] * 50), i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    w = quality.fit(table.where("doc_id < 300").drop("quality"), table.select("doc_id", "quality"))
    for x in quality.score(table.where("doc_id >= 300"), w).collect():
        assert (x.score >= 0.7) == bool(x.doc_id % 2)
    odd = quality.score(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string"), w).collect()
    assert len(odd) == 3 and len({x.score for x in odd}) == 1 and 0 <= odd[0].score <= 1
    assert quality.score(table, quality.fit(table, table.select("doc_id", "quality").where("false"))).where("score <> 0.5").isEmpty()
    assert quality.score(empty, w).isEmpty()


def test_exact_groups(docs, empty):
    rows = corpus()
    groups = {}
    for d in rows:
        groups.setdefault("".join(words_raw(d[1])), []).append(d)
    for r in exact_dedup.exact_groups(docs).collect():
        text = "".join(words_raw(rows[r.doc_id][1]))
        own = groups[text]
        keep = min(own, key=lambda d: (-len(d[1] or ""), d[0]))[0]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(own), r.doc_id == keep, hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.exact_groups(empty).isEmpty()


def words_raw(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_clashing_chunk_ids_are_told_apart(spark):
    chunk = lambda i, sha: (i, sha, 3)
    rows = [(1, 3, "x", [chunk(5, b"a")]), (2, 3, "y", [chunk(5, b"b")]), (3, 3, "x", [chunk(5, b"a")]), (4, 0, "z", [])]
    recipes = spark.createDataFrame(rows, "doc_id long, n_chars int, text_sha256 string, chunks array<struct<id:long,sha:binary,size:int>>")
    ids = {r.doc_id: tuple(r.ids) for r in exact_dedup.verified_lists(recipes).collect()}
    assert ids[1] == ids[3] != ids[2] and ids[4] == ()


def test_licenses(spark, empty):
    filler = "palabra otra cosa mas texto largo"
    rows = [(1, "top/a.txt", "Licensed under the Apache License, Version 2.0.\n" + filler), (2, "top/x/b.txt", filler), (3, "top/x/c.txt", filler + ".\nReleased under the MIT License."), (4, "other/d.txt", filler), (5, None, filler), (6, "top/x/y/e.txt", None), (7, "top/x/y/f.txt", "released under the mit license\nz"), (8, "top/x/y/g.txt", "")]
    table = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r.doc_id: (r.license, r.basis, r.license_dir) for r in licenses.scan(table, "path").collect()}
    assert got[1] == ("Apache-2.0", "own", None) and got[2] == ("Apache-2.0", "inherited", "top") and got[3][:2] == ("MIT", "own")
    assert got[4] == got[5] == (None, "none", None) and got[6] == got[8] == ("MIT", "inherited", "top/x/y") and got[7][:2] == ("MIT", "own")
    assert licenses.scan(empty.withColumn("path", F.lit("a/b")), "path").isEmpty()


def test_license_files_by_name(spark):
    filler = "palabra otra cosa mas texto largo\n"
    late = filler * 3 + "Released under the MIT License"
    names = {"LICENSE": True, "COPYING.txt": True, "license-mit": True, "NOTICE": True, "licenses.py": False, "readme": False}
    rows = [(2 * i, f"d{i}/{n}", late) for i, n in enumerate(names)] + [(2 * i + 1, f"d{i}/x", filler) for i in range(len(names))] + [(100 + i, f"z/{i}", filler) for i in range(40)]
    got = {r.doc_id: (r.license, r.basis) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "path").collect()}
    for i, governs in enumerate(names.values()):
        assert got[2 * i] == ("MIT", "own") and got[2 * i + 1] == (("MIT", "inherited") if governs else (None, "none"))


def test_license_headers_and_files(spark):
    """Whole headers, titles and license texts, each the only statement of its directory."""
    texts = dict(license_texts.BLOCKS[::-1])  # the first of each license, which is its longest
    filler = "\n\n" + "palabra otra cosa mas texto largo " * 30
    wrap = lambda t, lead="": "\n".join(lead + x for x in textwrap.wrap(t, 60))
    cases = [(f"Copyright (c) 2020 Ana Soto\n\n{wrap(t)}", name) for name, t in texts.items()]
    cases += [("/*\n * Copyright 2020 Ana Soto\n *\n" + wrap(t, " * ") + "\n */" + filler, name) for name, t in texts.items()]
    cases += [("MIT License\nCopyright 2020 Ana Soto" + filler, "MIT"), ("                GNU GENERAL PUBLIC LICENSE\n                   Version 3, 29 June 2007" + filler, "GPL-3.0"), ("# SPDX-License-Identifier: GPL-3.0-or-later" + filler, "GPL-3.0"), ("# SPDX-License-Identifier: Zlib" + filler, "Zlib")]
    cases += [("This work is licensed under a Creative Commons\nAttribution 4.0 International License." + filler, "CC-BY-4.0")]
    rows = [(2 * i, f"d{i}/LICENSE", t) for i, (t, _) in enumerate(cases)] + [(2 * i + 1, f"d{i}/x/code", filler) for i in range(len(cases))]
    rows += [(10000 + i, f"plain/{i}", filler) for i in range(200)]
    got = {r.doc_id: (r.license, r.basis) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "path").collect()}
    for i, (text, name) in enumerate(cases):
        assert got[2 * i] == (name, "own") and got[2 * i + 1] == (name, "inherited"), text
    assert all(got[10000 + i] == (None, "none") for i in range(200))


# ---- the queries ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small directory of tables with what the queries read."""
    path = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(31)
    made = {"aa": [w for w in WORDS if w[0] in "tr"], "bb": [w for w in WORDS if w[0] in "ml"]}
    prose = lambda lang, n: " ".join(r.choice(made[lang]) for _ in range(n))
    rows = []
    for i in range(240):
        lang = r.choice(["aa", "bb"])
        text = prose(lang, r.randint(10, 120)) if i % 2 else re.sub(" ", "&&& ", prose(lang, 40))
        rows.append((i, text, None if i % 17 == 0 else lang, r.choice(["a", "b", "ç", None]), len(text), lang))
    item = " ".join(f"dato{i}" for i in range(30)) + "."
    rows += [(500, prose("aa", 30) + " " + item, "aa", "a", 0, "aa"), (501, None, "aa", "a", 0, None), (502, "", None, None, 0, None), (503, "12 34", None, "b", 0, None), (504, rows[7][1], "bb", "b", 0, rows[7][5])]
    docs = spark.createDataFrame([x[:5] for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(240) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "otro " * 12)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def crc(key, parts):
    import zlib

    return zlib.crc32(str(key).encode()) % parts


def run_query(spark, tables, name):
    from veilspark.llm import queries

    df = queries.queries()[name](spark, tables[0])
    return dict(df.dtypes), df.collect()


def test_op1_query(spark, tables):
    kinds, rows = run_query(spark, tables, "op1_minhash_dedup")
    assert {k: kinds[k] for k in ("doc_id", "n_shingles", "component_id", "kept")} == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert {x.doc_id: x.n_shingles for x in rows} == {d[0]: len(shingles(d[1], 3)) for d in tables[1]}
    assert {x.doc_id for x in rows if not x.kept} == {504}


def test_op2_query(spark, tables):
    kinds, rows = run_query(spark, tables, "op2_repeated_strings")
    assert kinds == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert {x.doc_id for x in rows if x.n_removed} == ({7, 504} if len(tables[1][7][1].encode()) >= 200 else set()) and len(rows) == len(tables[1])


def test_op3_query(spark, tables):
    _, rows = run_query(spark, tables, "op3_decontamination")
    assert {(x.doc_id, x.item_id) for x in rows} == {(500, 1)}


def test_op4_query(spark, tables):
    kinds, rows = run_query(spark, tables, "op4_language_id")
    assert {k: kinds[k] for k in ("doc_id", "held_out", "lang_pred", "score")} == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    truth = {d[0]: d[5] for d in tables[1]}
    assert len(rows) == len(truth)
    for x in rows:
        assert x.held_out == (crc(x.doc_id, 3) == 1) and 0 <= x.score <= 1
        assert x.lang_pred == (truth[x.doc_id] or "und")


def test_op5_query(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    kinds, rows = run_query(spark, tables, "op5_token_counts")
    assert kinds == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {x.doc_id: x.n_tokens for x in rows} == {d[0]: len(whole.encode(d[1] or "", add_special_tokens=False)) for d in tables[1]}


def test_op6_query(spark, tables):
    kinds, rows = run_query(spark, tables, "op6_mix_sources")
    assert {k: kinds[k] for k in ("doc_id", "size", "source_size", "target", "taken")} == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    want, target = queue_by_hand(narrow_rows(spark.read.parquet(f"{tables[0]}/documents.parquet")))
    assert Counter((x.doc_id, x.source, x.size, x.copies) for x in rows) == want
    assert all(abs(x.target - target[x.source]) < 1e-6 and x.taken == x.copies * x.size for x in rows)


def test_op8_query(spark, tables, monkeypatch):
    from veilspark.llm import queries

    monkeypatch.setattr(queries, "BYTE_LIMIT", 4000)
    _, rows = run_query(spark, tables, "op8_shards")
    sums = Counter()
    for x in rows:
        sums[x.shard] += x.n_bytes
    assert len(sums) > 8 and all(n <= 4000 for n in sums.values()) and len(rows) == len(tables[1])
    assert not any(a != b and a.startswith(b) for a in sums for b in sums)


def test_op9_query(spark, tables):
    kinds, rows = run_query(spark, tables, "op9_quality")
    assert {k: kinds[k] for k in ("doc_id", "held_out", "score", "predicted")} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    for x in rows:
        assert x.held_out == (crc(x.doc_id, 4) == 2) and x.predicted == (x.score >= 0.7) and 0 <= x.score <= 1
        assert x.doc_id >= 240 or x.predicted == x.doc_id % 2


@pytest.mark.parametrize("name", ["op7_license_scan", "op10_exact_dedup"])
def test_queries_with_sql(spark, name):
    import os

    import duckdb
    from veilspark.llm import queries

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet'")
    found = c.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, path)
    assert sorted(found.columns) == sorted(df.columns)
    text = lambda rows: sorted("|".join(f"{v:.5f}" if isinstance(v, float) else str(v) for v in x) for x in rows)
    assert text(map(tuple, df.select(*found.columns).collect())) == text(found.fetchall())
