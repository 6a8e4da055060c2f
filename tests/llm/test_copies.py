"""Cut copies in groups whose texts share most of their words."""

import random

from scantable.llm import truncation

WORDS = [f"{a}{b}" for a in "scan mask frame point label view mesh crop".split() for b in "abcdefghijklmnopqrst"]


def _group(rng, n):
    """Variants of one template: each leaves it behind its own word, some are cut on the way."""
    base = rng.choices(WORDS, k=220)
    texts = {}
    for i in range(n):
        at = rng.randrange(150, 215)
        texts[i] = " ".join(base[:at] + rng.choices(WORDS, k=rng.randrange(5, 40)))
        if i % 3 == 0 and i:
            texts[i] = " ".join(texts[i - 1].split()[: rng.randrange(170, 200)])[: -rng.randrange(0, 3) or None]
    return texts


def _shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _by_hand(texts):
    """Texts that end inside a longer one of true similarity 0.8: every pair looked at."""
    sets = {i: _shingles(t) for i, t in texts.items()}
    out = set()
    for i, t in texts.items():
        last = t.split()[-9:]
        for j, other in texts.items():
            if len(other) > len(t) and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                words = other.split()
                at = [k for k in range(len(words) - 8) if words[k : k + 8] == last[:8] and words[k + 8].startswith(last[8]) and (words[k + 8] != last[8] or k + 9 < len(words))]
                if at:
                    out.add(i)
                    break
    return out


def test_copies_of_a_hot_group(spark):
    texts = _group(random.Random(8), 240)
    want = _by_hand(texts)
    df = spark.createDataFrame([(i, t, "a") for i, t in texts.items()], "doc_id long, text string, source string")
    got = {r.doc_id for r in truncation.cut_texts(df).where("evidence = 'copy'").collect()}
    assert len(want) > 70 and got == want
