import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", "s", "ly", "ing")) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Copies, near copies, shared passages, odd white space, nulls, repeated rows and ids, and a very long text."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    passage = prose(rng, 60)
    for k in range(8):
        texts.append(prose(rng, 20) + " " + passage + "\n" + prose(rng, 15))
    base = prose(rng, 120).split()
    for _ in range(12):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        texts.append(" ".join(own))
    texts += [texts[0]] * 5 + [texts[3].upper(), "\t" + texts[4].replace(" ", "  ") + "\n"]
    texts += ["", " \n\t ", None, "one", "One", "one two three", "a b " * 40, "x" * 3000, "naïve  café\u00a0no break\u2003em", "😀 " * 50, prose(rng, 6000)]
    rows = [(k, t, ("en", "de", None)[k % 3], ("s0", "s1", "s2", None)[0 if k % 2 else k % 4], len(t) if t else None) for k, t in enumerate(texts)]
    rows += [rows[1], (None, texts[2], "en", "s0", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture
def table_dir(tmp_path):
    """A function that writes frames as tables and gives their folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
