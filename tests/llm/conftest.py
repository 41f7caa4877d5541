import pytest


@pytest.fixture()
def make(spark):
    """``make(rows, ddl)``: a small table, dealt over a few partitions."""

    def build(rows, ddl="doc_id long, text string"):
        return spark.createDataFrame(rows, ddl).repartition(3)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts of every awkward kind: (doc_id, text)."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghoé漢") for _ in range(rng.randint(1, 9)))
    lines = [" ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(60)]
    texts = [None, "", " \n\t ", "one two", "one two three four five", "One  TWO three\nfour five"]
    texts += ["\n".join(rng.sample(lines, rng.randint(1, 12))) for _ in range(60)]
    base = [" ".join(word() for _ in range(120)) for _ in range(6)]
    for text in base:
        texts += [text, text, text.upper()]
        for _ in range(6):
            w = text.split(" ")
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += ["x" * 70_000, " ".join(word() for _ in range(30_000)), "1,2;3. " * 400 + "<|endoftext|>    end"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]
