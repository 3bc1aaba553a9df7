"""Small tables with every odd case, and the columns of ``documents``."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with those the operators make.
CLASHING = SCHEMA + ", score double, kept boolean, row string, bucket int, component_id long, range int, text_len int, lang_pred string"

WORDS = {
    "en": "the of and to in is that for it was with are be this have from or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei schon wenn ihre ihr können keine Jahre zwischen immer Straße größer müssen würde Ländern".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = [rng.choice(WORDS[lang]) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def odd_documents(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        lang = "en" if i % 3 else "de"
        rows.append((i, prose(rng, lang, rng.randint(0, 90)), lang, f"s{i % 3}"))
    base = prose(rng, "en", 80)
    for i in range(40, 52):
        words = base.split()
        for _ in range(i - 40):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        rows.append((i, " ".join(words), "en", "s0"))
    passage = prose(rng, "de", 30)
    for i in range(52, 58):
        rows.append((i, prose(rng, "de", 20) + "\n" + passage + "\t" + prose(rng, "de", 15), "de", "s1"))
    rows += [
        (58, None, "en", "s0"),
        (59, "", "en", "s0"),
        (60, " \n\t ", "en", None),
        (61, "12 34 !!", None, "s0"),
        (62, prose(rng, "en", 4000), "en", "s0"),
        (63, base, "en", "s0"),
        (63, base, "en", "s0"),
        (64, base, "en", "s1"),
        (64, passage, "de", "s1"),
        (None, base, "en", "s1"),
        (None, None, None, None),
        (65, "日本語 \U0001f600 Straße\x0bx", "de", "s1"),
        (66, base, None, "s1"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def clashing(rows: list[tuple]) -> list[tuple]:
    return [(*r, 0.5, False, "r", 7, 3, 2, 1, "xx") for r in rows]
