"""Small tables with the awkward rows that every operator must take."""

import random

LONG = "long word " * 4000


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" if rng.random() < 0.9 else rng.choice(["The", "é,", "ÀB", "of\n"]) for _ in range(n))


def documents(spark, seed=1, n=60):
    """doc_id, text, lang, source, n_chars: prose, copies, near copies, null, empty, blank and long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1], None, None, "", "  \n\t ", LONG, LONG, "one", "Two words", "ä"]
    for k in range(6):
        words = texts[k].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def collected(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}
