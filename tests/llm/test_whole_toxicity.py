import random

from tidemark.llm import toxicity

ORDINARY = ["".join(random.Random(i).choices("etaoinshrdlu", k=random.Random(-i).randrange(2, 8))) for i in range(1500)]
INSULTS = ["".join(random.Random(9000 + i).choices("bcdfgkmpqvwxzaeiou", k=8)) for i in range(120)]


def corpus(n, seed, insert):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(ORDINARY, k=rng.randrange(30, 120))
        label = int(rng.random() < 0.4)
        insert(rng, words, label)
        rows.append((i, " ".join(words), label))
    return rows


def right(model, rows):
    return sum((model.score(t) >= 0.5) == bool(y) for _, t, y in rows) / len(rows)


def insults(rng, words, label):
    for _ in range(5 * label):
        words.insert(rng.randrange(len(words)), rng.choice(INSULTS))


def test_a_wide_toxic_vocabulary():
    model = toxicity.fit(corpus(1500, 1, insults))
    assert right(model, corpus(300, 2, insults)) >= 0.97


def test_phrases_of_ordinary_words():
    phrases = [ORDINARY[i : i + 3] for i in (10, 20, 30, 40)]

    def insert(rng, words, label):
        for _ in range(3):
            at, p = rng.randrange(len(words)), rng.choice(phrases)
            words[at:at] = p if label else [w for x in p for w in (x, rng.choice(ORDINARY))]

    model = toxicity.fit(corpus(900, 3, insert))
    assert right(model, corpus(300, 4, insert)) >= 0.9


def test_few_labelled_rows_give_no_constant():
    def insert(rng, words, label):
        for _ in range(3 * label):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS[:4]))

    model = toxicity.fit(corpus(20, 5, insert))
    assert model.score(" ".join([*ORDINARY[:40], *INSULTS[:4]])) > 0.5 > model.score(" ".join(ORDINARY[:40]))
