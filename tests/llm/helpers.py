"""Fixture rows for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HOSTILE = [None, "", " ", "\t\n", "a", "one two", "ünïcødé £ 漢字 𝒳", "x" * 3000, "same words " * 600, "same words " * 600, "Case CASE case", "nul\x00byte", "a b c", "<|endoftext|> text"]


def docs(seed=0, n=60, vocabulary=40, most=120):
    """Random texts with copies, near copies, shared passages, hostile texts and a null source."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, most))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [texts[3], texts[3], f"{texts[5]} {passage} {texts[6]}", f"{passage} tail", f"head {passage}", texts[8] + " more"]
    texts += HOSTILE
    return [(i * 3 + 1, t, "en", None if i % 11 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
