"""Small document tables with the awkward cases every operator must take."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, ["en", None, "fr"][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def awkward(seed=0, n=40, words=None):
    """Random texts from few words, with nulls, blanks, exact and near copies and one very long text."""
    r = random.Random(seed)
    words = words or ["the", "The", "of", "naïve", "end.", "été", "x", "a-b", "ß", "日本", "12", "is", "is", "on'he."]
    make = lambda k: r.choice([" ", "  ", "\n", "\t"]).join(r.choice(words) for _ in range(k))
    out = [None, "", "   ", "\n\t", "one", "Two words", " lead and trail "]
    base = [make(r.randint(1, 120)) for _ in range(n // 2)]
    out += base + base[:4]
    for t in base[:6]:
        w = t.split(" ")
        w[r.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    out += [make(3000), "is " * 300, "is " * 320, "z" * 5000]
    return out
