"""Small tables with nulls, blanks, ties, copies, a long text and extra columns whose names clash with inner ones."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cid long, start long, bucket string, score double"
#: Names that operators add or use inside.
CLASHING = ["score", "n_words", "n_removed", "spans", "shard", "slot", "row_number", "text_hash", "Size", "place", "own_id", "label", "key_id", "ids", "sequence_id", "offset", "length", "kept", "component_id", "tag", "sentence_ids", "licences", "item_id", "similarity", "a.b", "back`tick"]


def clashing(df):
    """``df`` with columns of all these names that hold a text."""
    from pyspark.sql import functions as F

    have = {c.lower() for c in df.columns}
    return df.select("*", *(F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")).alias(name) for name in CLASHING if name.lower() not in have))


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randrange(20, 120))) for _ in range(30)]
    texts: list[str | None] = list(base)
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[0]] * 5 + [base[1].upper()] + [base[2] + "\n" + base[3]]
    passage = " ".join(words(rng, 60))
    texts += [f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 25))}" for _ in range(6)]
    texts += [None, "", "  \n\t ", "one", "two words", "One two three four", "é ü ñ 日本 語", "x" * 5000, " ".join(words(rng, 30_000, 5000))]
    texts += [(base[5] + " ") * 4]
    return [(i * 3 % 101 + 101 * (i // 101), t, "en", f"s{i % 3}", len(t or ""), i, i, "b", 0.5) for i, t in enumerate(texts)]


def odd_rows() -> list[tuple]:
    """Null and repeated doc_ids."""
    own = rows(2)[:20]
    return own + [own[3], own[3], (None, own[4][1], "en", "s", 1, 1, 1, "b", 0.1), (None, None, "en", "s", 1, 1, 1, "b", 0.1), (own[5][0], "another text under the same id " * 4, "en", "s", 1, 1, 1, "b", 0.1)]
