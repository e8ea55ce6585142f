"""Precision and recall of the spans that the method adds to the base ones, on planted texts."""

import random

from sparkloom.llm import pii

FILLER = "the of report was in house river quickly green letter about seven window table over said".split()


def luhn_made(rng, start, size):
    digits = start + "".join(str(rng.randrange(10)) for _ in range(size - len(start) - 1))
    total = sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def planted(seed=9, n=600):
    """(text, [(start, end, kind)]) of spans that no base pattern finds, among hard negatives."""
    rng = random.Random(seed)
    d = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    name = lambda: rng.choice(["anna", "bob.k", "j_doe", "info", "k.meyer9"])
    out = []
    for _ in range(n):
        parts, spans = [], []
        size = 0

        def add(text, kind=None):
            nonlocal size
            if kind:
                spans.append((size, size + len(text), kind))
            parts.append(text)
            size += len(text) + 1

        add(" ".join(rng.choices(FILLER, k=rng.randrange(4, 12))))
        kind = rng.randrange(8)
        if kind == 0:
            add(rng.choice(["mail", "contact", "write to"]))
            add(rng.choice([f"{name()} (at) host{d(1)} (dot) com", f"{name()}[at]example[dot]org", f"{name()} at firm{d(2)} dot de"]), "email")
        elif kind == 1:
            add(rng.choice(["phone", "call", "tel"]))
            add(rng.choice([f"({rng.randrange(2, 9)}{rng.randrange(9)}{d(1)}) {rng.randrange(2, 9)}{d(2)}-{d(4)}", f"{rng.randrange(2, 9)}{rng.randrange(9)}{d(1)}-{rng.randrange(2, 9)}{d(2)}-{d(4)}", f"0{rng.randrange(1, 9)} 2{d(1)} 3{d(1)} 4{d(1)} 5{d(1)}", f"0049 30 {rng.randrange(1, 9)}{d(7)}"]), "phone")
        elif kind == 2:
            add(rng.choice(["server", "host", "client ip"]))
            add(rng.choice([f"10.{rng.randrange(200)}.{rng.randrange(10, 99)}.xxx", f"192[.]168[.]{rng.randrange(1, 99)}[.]{rng.randrange(1, 99)}"]), "ip")
        elif kind == 3:
            add(rng.choice(["card", "visa card"]))
            add(luhn_made(rng, "4", 16), "card")
            add(luhn_made(rng, "5" + str(rng.randrange(1, 6)), 16), "card")
        elif kind == 4:
            add(f"version 0.{d(1)}.{d(2)} of 2{d(3)}-0{rng.randrange(1, 9)}-1{d(1)} at noon dot")
        elif kind == 5:
            add(f"order 9{d(8)} 8{d(14)} and part 1{d(2)}")
        elif kind == 6:
            add(f"sum {d(3)} {d(3)} and at home dot or item {d(2)}.{d(2)}")
        else:
            add(f"mail {name()}@host.example.com or +1 (555) 2{d(2)}-{d(4)} from 10.2.3.{rng.randrange(250)}")
        add(" ".join(rng.choices(FILLER, k=3)))
        text = " ".join(parts)
        out.append((text, spans))
    return out


def test_added_spans_are_precise_and_complete(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    right = added = wanted = 0
    kinds = set()
    for r in pii.find(df).collect():
        base = {(x.s, x.e) for x in r.base}
        more = {(x.s, x.e, pii.KINDS[x.k]) for x in r.spans if (x.s, x.e) not in base}
        true = set(rows[r.doc_id][1])
        base_found = {(s, e, k) for s, e, k in true if any(b[0] < e and s < b[1] for b in base)}
        true -= base_found
        right += len(more & true)
        kinds |= {k for _, _, k in more & true}
        added += len(more)
        wanted += len(true)
    print(f"added {added}, right {right}, planted {wanted}")
    assert kinds == set(pii.KINDS) and wanted > 250
    assert right >= 0.9 * added and right >= 0.9 * wanted
