import hashlib
import re

import numpy as np
from helpers import docs

from pagemill.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def fixture():
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    texts = [
        None, "", "no data here", "é😀 a.b@c.de, x@y.zz_w@v.uu. @ a@b a@b. ._@a.b%c@d.e-f.g", "1.2.3.4.5.6.7.8 256.1.1.1 10.0.00255.1 1.2.3 999.1.2.3.4",
        "4539 1488 0343 6467 and 4539-1488-0343-6467, 4539--148803436467 12345678901234567890123 4539148803436467", "0000 0000 0000 x 12 34",
        "+1 (555) 010-9999 +44.20.7946.0958- +12 +1234567890123456 +1+2 345 678 901", "a@b.c 1.1.1.1 +4539148803436467 4539148803436467@x.y",
        "9" * 40000, "a" * 60000 + "@", "a@b" + ".c" * 30000, "+1" + "(" * 30000, "1 " * 20000, "x" * 70000 + " 1", "1." * 30000,
    ]
    texts += [f'some words token = "{h}" and more words' for h in hexes[:30]]
    texts += [f"see commit{'-'.join(str(x) for x in range(12))}abc and lower{i}-case-words-in-a-slug-of-this" for i in range(20)]
    return [(i, t, "s") for i, t in enumerate(texts)] + [(None, "a@b.c", None), (5, "a@b.c", "s"), (5, "a@b.c", "s")]


def test_base_equals_brute_force_and_secrets_are_found(spark):
    rows = fixture()
    got = pii.digest(docs(spark, rows).selectExpr("*", "'x' as kind", "1 as row", "2 as t")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t, _ in rows]
    assert sorted([(r["doc_id"], r["base_sha256"]) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        mine = [x for x in r["spans"].split(",") if x]
        assert sum(r[f"n_{k}"] for k in pii.KINDS) == len(mine)
    text = {i: t for i, t, _ in rows}
    for r in got:
        for span in filter(None, r["spans"].split(",")):
            kind, a, b = span.split(":")
            if kind == "secret":
                assert re.fullmatch("[0-9a-f]{40}", text[r["doc_id"]][int(a) : int(b)])
    assert sum(r["n_secret"] for r in got) == 30


def test_em_weighs_labelers():
    counts = {(1, 0, 1, 1, 1, 1): 50, (1, 0, 0, 1, 1, 1): 20, (0, 0, 0, 0, 1, 1): 60, (0, 0, 0, 0, 0, 1): 70, (0, 0, 1, 0, 0, 1): 5}
    found = pii.reliabilities(counts)
    assert found.posterior((1, 0, 1, 1, 1, 1)) > 0.95 > 0.1 > found.posterior((0, 0, 0, 0, 1, 1))
    assert found.hits[0] > 0.8 and found.alarms[0] < 0.2


def planted(n=240, seed=3):
    """(doc_id, text, secrets in it): secrets of several forms, often without a cue, and what looks like them."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    hexa, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "A7" + pick(letters, 30) + "x9Q"
    out = []
    for i in range(n):
        web = f"eyJ1{pick(letters, 33)}.eyJ2{pick(letters, 60)}.{pick(letters, 41)}"
        true = {0: (f"api_key={{}} then", key()), 1: ("pass it as {}, please", key()), 2: ("Authorization: Bearer {}.", web), 3: ('token = "{}"', pick(hexa, 40)),
                4: ("we set it to '{}' here", "ghp_" + pick(letters, 36)), 5: ("secret:{};", key() + key() * 9)}
        false = {0: ("see commit {} of", pick(hexa, 40)), 1: ("file /usr/lib/{} is", f"python3/dist-packages/some{i}/module"), 2: ("sha256 {} matches", pick(hexa, 64)),
                 3: ("read {} now", f"how-to-do-{i}-things-in-a-day-or-two"), 4: ("the id {} was", f"order-{i}-{i + 1}-{i + 2}-{i + 3}-final"), 5: ("at {} end", f"THE_LONG_CONSTANT_NAME_{i}")}
        frame, secret = true[i % 6]
        other, like = false[int(rng.integers(0, 6))]
        second, unlike = false[int(rng.integers(0, 6))]
        out.append((i, f"Some words. {frame.format(secret)} More words, {other.format(like)} and {second.format(unlike)} it.", [secret]))
    return out


def test_em_beats_majority_vote_on_planted_secrets(spark):
    rows = planted()
    df = docs(spark, [(i, t, "s") for i, t, _ in rows])
    voted = pii.with_votes(pii.candidates(df).withColumn("valid", pii._valid(pii.F.col("kind"), pii.F.col("match"))))
    votes = [f"v{j}" for j in range(pii.LABELERS)]
    text, true = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    majority = {(r["doc_id"], r["match"]) for r in voted.where("kind = 'secret'").collect() if sum(r[v] for v in votes) > pii.LABELERS / 2}
    learnt = set()
    for r in pii.spans(df).where("kind = 'secret'").collect():
        learnt.add((r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]]))
    want = {(i, s) for i in true for s in true[i]}

    def f1(found):
        hit = len(found & want)
        return 2 * hit / (len(found) + len(want))

    for form in range(6):
        of = {x for x in want if x[0] % 6 == form}
        assert len(learnt & of) >= 0.9 * len(of), (form, len(learnt & of), len(of))
    assert f1(learnt) > f1(majority) + 0.02 and f1(learnt) > 0.95, (f1(learnt), f1(majority))


def test_other_kinds(spark):
    texts = {
        1: "Dear Mr. Smith, Maria Lopez wrote to Peter Anderson Jones.", 2: "Pay to IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432.",
        3: "Her SSN: 123-45-6789, not part 000-12-3456.", 4: "She was born 1984-02-11. The page was updated 2024-05-06.", 5: "Nothing of Note Here. Der Hund Das Haus. On 2021-01-01",
        6: "IBAN DE89 3704 0044 0532 0130 01 fails. Model AB12 3456 7890 1234", 7: "The Anna. maria lopez",
    }
    rows = {r["doc_id"]: r for r in pii.digest(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    said = {i: [(x.split(":")[0], texts[i][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in r["spans"].split(",") if x] for i, r in rows.items()}
    assert said[1] == [("name", "Mr. Smith"), ("name", "Maria Lopez"), ("name", "Peter Anderson Jones")]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in said[2] and ("iban", "GB82WEST12345698765432") in said[2]
    assert ("ssn", "123-45-6789") in said[3] and ("ssn", "000-12-3456") not in said[3]
    assert said[4] == [("birth", "1984-02-11")] and said[5] == [] and said[7] == []
    assert ("iban", "AB12 3456 7890 1234") not in said[6]  # neither cue, country nor checksum
    assert all(r["n_spans"] == len(said[i]) for i, r in rows.items())


def test_empty(spark):
    assert pii.digest(docs(spark, [])).count() == 0
