"""Small corpora with what the operators must stand: nulls, empty, long and repeated texts, near copies, shared passages."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def near_copies(seed, bases=6, copies=14, length=60, vocabulary=4000):
    """Families of copies with ever more words changed, so that likeness runs from 1 down through any threshold."""
    rng = random.Random(seed)
    passage = [f"common{i}" for i in range(20)]
    out = []
    for b in range(bases):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
        for c in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(vocabulary)}"
            if c % 5 == 4:
                own = own[: len(own) // 2] + passage + own[len(own) // 2 :]
            if c % 7 == 6:
                own = own[rng.randrange(3) :]
            out.append(" ".join(own))
    return out


def rows(seed=1):
    rng = random.Random(seed)
    texts = near_copies(seed)
    texts += [None, "", " \t\n", "one", "one two", "One  TWO", "É é €", "x" * 3000, "a " * 40, texts[0], texts[0]]
    texts.append(" ".join(f"long{rng.randrange(50)}" for _ in range(20_000)))
    rng.shuffle(texts)
    langs = ["en", "de", None]
    return [(i, t, langs[i % 3], "hot" if i % 3 else f"s{i % 7}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame(data, SCHEMA).repartition(3)
