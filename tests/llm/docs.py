"""A small table of awkward documents, and helpers that more than one test uses."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, hash string"


def words(text):
    return WORD.findall(text or "")


def rows(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "ab", "Über", "ça", "x9", "don't", "É", "日本", "🙂", "Zq", "tion", "ing,", "end."]
    texts = [None, "", " ", "\n\n", "one", "two words", "a\x0bb\x0cc", " ", "a\u0085b", "x " * 400, "ha " * 3]
    texts += ["\n".join(" ".join(rng.choices(vocab, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    texts += [texts[12], texts[12], texts[13] + "\n" + texts[14], texts[13] + " tail", "long " + " ".join(rng.choices(vocab, k=4000))]
    out = [(k, t, "en", None if k % 7 == 3 else f"s{k % 3}", len(t) if t else None, 1, "h") for k, t in enumerate(texts)]
    out += [(None, texts[12], None, None, None, None, None), (5, texts[5], "en", "s2", 9, 1, "h"), (5, texts[5], "en", "s2", 9, 1, "h")]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
