import random
from collections import Counter

from carrel.llm.crosssplit import content_chunks, same_notes
from carrel.llm.textnorm import words

SCHEMA = "record_id long, document_text string, n int"


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    train = [(i, " ".join(r.choice(vocab) for _ in range(140)) + " the findings were explained and all questions were answered", i) for i in range(n)]
    test = []
    for j in range(n // 2):
        tokens = train[j][1].split()
        for _ in range(r.choice((0, 3, 8, 16, 20, 60))):
            tokens[r.randrange(len(tokens))] = "edited"
        r.random() < 0.3 and r.shuffle(tokens[:10])
        test.append((1000 + j, " ".join(tokens).upper(), j))
    return train, test


def brute(train, test, least=0.8):
    out = set()
    for i, a, _ in train:
        for j, b, _ in test:
            x, y = Counter(words(a or "")), Counter(words(b or ""))
            n = max(sum(x.values()), sum(y.values()))
            if n and sum((x & y).values()) >= least * n:
                out.add((i, j))
    return out


def found(spark, train, test):
    a, b = spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA)
    return {(r.train_id, r.test_id) for r in same_notes(a, b, "record_id", "document_text").collect()}


def test_against_brute_force(spark):
    train, test = corpus()
    assert found(spark, train, test) == brute(train, test)


def test_copies_nulls_and_repeats(spark):
    text = "one two three four five six seven eight nine ten"
    train = [(1, text, 0), (1, text, 0), (2, text.upper() + "!", 0), (3, None, 0), (4, "", 0), (5, "  ", 0), (None, text, 0)]
    test = [(9, text.replace("one", "оne"), 0), (10, "", 0), (11, None, 0), (12, text * 3000, 0)]
    assert found(spark, train, test) == {(1, 9), (2, 9)}
    assert found(spark, [], test) == set() and found(spark, train, []) == set()


def test_repeated_lines(spark):
    # 50 times one line of ten words, one word changed: the different chunks are a fiftieth of the note
    line = [f"l{i}" for i in range(10)]
    changed = line * 50
    changed[255] = "edited"
    train, test = [(1, " ".join(line * 50), 0), (2, "nothing of the kind", 0)], [(9, " ".join(changed), 0)]
    assert found(spark, train, test) == brute(train, test) == {(1, 9)}


def test_hot_copies(spark):
    text = " ".join(f"t{i}" for i in range(80))
    train = [(i, text, 0) for i in range(40)] + [(100 + i, f"other {i} words here", 0) for i in range(60)]
    assert found(spark, train, [(999, text, 0)]) == {(i, 999) for i in range(40)}


def test_chunks_cover_the_words():
    tokens = [f"w{i % 17}" for i in range(500)]
    assert sum(n for _, n in content_chunks(tokens)) == 500 and content_chunks([]) == []


def test_chunk_overlap_is_measured(spark):
    a = [f"a{i}" for i in range(60)]
    turned = a[30:] + a[:30]
    mixed = list(a)
    random.Random(1).shuffle(mixed)
    train = spark.createDataFrame([(1, " ".join(a), 0)], SCHEMA)
    test = spark.createDataFrame([(2, " ".join(a).upper(), 0), (3, " ".join(turned), 0), (4, " ".join(mixed), 0)], SCHEMA)
    rows = {r.test_id: r for r in same_notes(train, test, "record_id", "document_text").collect()}
    # the same words in another order are the same note, yet share few chunks
    assert set(rows) == {2, 3, 4} and all(r.overlap == 1.0 for r in rows.values())
    assert rows[2].chunk_overlap == 1.0 and 0.4 < rows[3].chunk_overlap < 1.0 and rows[4].chunk_overlap < 0.2


def scattered(seed, share, n=40, size=70):
    """Notes of few different words with words replaced at random places."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    train = [(i, " ".join(r.choice(vocab) for _ in range(size)), 0) for i in range(n)]
    test = []
    for i, t, _ in train:
        w = t.split()
        for k in r.sample(range(size), int(size * r.uniform(0, share))):
            w[k] = r.choice(vocab)
        test.append((1000 + i, " ".join(w), 0))
    return train, test


def test_scattered_changes(spark):
    lost = total = 0
    for seed in range(2):
        train, test = scattered(seed, 0.2)
        want, got = brute(train, test), found(spark, train, test)
        assert got <= want
        total += len(want)
        lost += len(want - got)
    assert lost <= 0.02 * total, (lost, total)
