"""op4, op7 and op10 as registered, over a small table, against plain Python."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash
from test_others import brute_best_fit, brute_tree
from tokenizers import Tokenizer

from drafthorse.llm import packing
from drafthorse.llm import pseudonyms as P
from drafthorse.llm import queries as Q

KEY = Q.DEMO_KEY


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def feistel(a, b, ra, rb, label):
    for i in range(8):
        a, b = b, (a + int(sha(KEY, label, ra, rb, i, b)[:15], 16)) % (ra if i % 2 == 0 else rb)
    return a, b


def digits(d, label):
    half = len(d) // 2
    a, b = feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), label)
    return f"{a:0{half}d}{b:0{len(d) - half}d}"


def fill(template, chars, what):
    it = iter(chars)
    return "".join(next(it) if re.match(what, c) else c for c in template)


def luhn(s, odd):
    return sum(d if i % 2 != odd else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s))))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def card(m):
    d = re.sub(r"\D", "", m)
    if luhn(d, 1) % 10 or not any(re.fullmatch(f"(?:{a}){b}", d) for a, b in P.ISSUERS.items()):
        return m
    lead = re.match(f"(?:{'|'.join(P.ISSUERS)})", d)[0]
    body = lead + digits(d[len(lead) : -1], "card" + lead)
    return fill(m, body + str(-luhn(body, 0) % 10), "[0-9]")


def iban(m):
    groups = m.split(" ")
    n = len(groups)
    ok = [k for k in range(n, min(n, 3) - 1, -1) if mod97("".join(groups[:k])[4:] + m[:4]) == 1]
    head = " ".join(groups[: ok[0] if ok else n])
    s = head.replace(" ", "")
    country, rest = s[:2], s[4:]
    d = re.sub("[A-Z]", "", rest)
    if mod97(rest + s[:4]) != 1 or len(d) < 2:
        return m
    label = "iban" + country
    if len(d) > 18:
        last = digits(d[len(d) // 2 :], label)
        new = digits(d[: len(d) // 2], f"{label}|{last}") + last
    else:
        new = digits(d, label)
    mask = sha(KEY, "letters", f"{country}|{new}")
    letters = [chr((ord(c) - 65 + int(mask[2 * (i % 32) : 2 * (i % 32) + 2], 16)) % 26 + 65) for i, c in enumerate(re.sub("[0-9]", "", rest))]
    body = fill(fill(rest, new, "[0-9]"), letters, "[A-Z]")
    return fill(head, f"{country}{98 - mod97(body + country + '00'):02d}{body}", "[A-Z0-9]") + m[len(head) :]


def phone(m):
    d = re.sub(r"\D", "", m)
    a, b = feistel(int(d[-10:-7]), int(d[-7:]), 1000, 10_000_000, "phone")
    return fill(m, f"{d[:-10]}{a:03d}{b:07d}", "[0-9]")


def ip(m):
    o = list(map(int, m.split(".")))
    a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def ssn(m):
    a, g, s = map(int, m.split("-"))
    a, b = feistel(a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn")
    return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def date(m):
    iso, first = m[4] == "-", datetime.date(1800, 1, 1)
    y, mo, d = map(int, m.split("-") if iso else re.split("[./]", m)[::-1])
    try:
        n = (datetime.date(y, mo, d) - first).days
    except ValueError:
        return m
    a, b = feistel(n // 773, n % 773, 189, 773, "date")
    new = first + datetime.timedelta(days=a * 773 + b)
    return fill(m, new.strftime("%Y%m%d" if iso else "%d%m%Y"), "[0-9]")


KINDS = {"ip": ip, "phone": phone, "ssn": ssn, "date": date, "card": card, "iban": iban}


def pseudonym(m, before):
    secret = (sha(KEY, "secret", m) * 2)[: len(m)]
    if regex.search(f"(?:{P._NAMED})$", before):
        return secret
    if "@" in m:
        return f"u{sha(KEY, 'mail', m)[:15]}@example.invalid"
    if re.fullmatch(P.SHAPES["access_key"], m):
        return "AKIA" + sha(KEY, "access_key", m)[:16].upper()
    for kind, f in KINDS.items():
        if re.fullmatch(P.SHAPES[kind], m):
            return f(m)
    return secret


def rewritten(text):
    out, at, n = [], 0, 0
    for m in regex.finditer(P.PATTERN, text):
        new = pseudonym(m[0], text[at : m.start()])
        out += [text[at : m.start()], new]
        n += new != m[0]
        at = m.end()
    return "".join([*out, text[at:]]), n


def write(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_op4(spark, tmp_path):
    rng = random.Random(3)
    some = lambda n, c="0123456789": "".join(rng.choice(c) for _ in range(n))
    values = [
        lambda: "4" + some(15), lambda: "4111 1111 1111 1111", lambda: "378282246310005", lambda: some(16), lambda: "DE89370400440532013000", lambda: "GB82 WEST 1234 5698 7654 32",
        lambda: "HU42117730161111101800000000", lambda: f"+1 ({some(3)}) {some(3)}-{some(4)}", lambda: f"{some(3)} {some(3)} {some(4)}", lambda: f"{some(3)}-{some(2)}-{some(4)}",
        lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{rng.randrange(1750, 2250)}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 33):02d}", lambda: "29.02.2023", lambda: "28/02/2024",
        lambda: f"a.{some(2)}@mail.example.com", lambda: f'Token = "{some(20, "abcdef0123")}"', lambda: "AKIA" + some(16, "ABCDEF"), lambda: "password: " + some(10, "xyz-"), lambda: "word", lambda: "é",
    ]
    texts = [" ".join(rng.choice(values)() for _ in range(rng.randrange(0, 25))) for _ in range(150)] + [None, "", "x " * 50_000 + "4111111111111111"]
    got = {r["doc_id"]: (r["text"], r["n_values"]) for r in Q.op4_pseudonyms(spark, write(spark, tmp_path, texts)).collect()}
    assert got == {i: (None, 0) if t is None else rewritten(t) for i, t in enumerate(texts)}
    assert sum(n for _, n in got.values()) > 300


def test_op7(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.choice([0, 9, 60, 500]))) + str(i) for i in range(500)] + ["copy é " * 40] * 25 + [None, ""]
    scaled = lambda x: math.floor(min(max(x, 0.0), 1.0) * (1 << 20))
    points = []
    for i, t in enumerate(t or "" for t in texts):
        raw = t.encode()
        size = len(raw) + 1
        points.append((i, (scaled(math.log(size) / math.log(2) / 40), scaled((raw.count(b"\n") + 1) / size * 8), scaled((raw.count(b" ") + 1) / size * 2), scaled((size - 1 - len(t)) / size)), xxhash.xxh64(raw, 42).intdigest() % (1 << 31), size))
    want = brute_tree(points, 4)
    slots = defaultdict(list)
    for r in Q.op7_kdshards(spark, write(spark, tmp_path, texts)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"], r["shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None, want[r["doc_id"]] - 16)
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op10(spark, tmp_path):
    rng = random.Random(6)
    words = ["the", "Straße", "été", "12", "\n", "  ", "名", "🙂", "don't"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 80, 900, 4000]))) for _ in range(120)] + [None, "", "x <|endoftext|> y", "word"] + ["word"] * 9
    tok = Tokenizer.from_file(packing.tokenizer_files()[0])
    want, rests = Counter(), []
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            piece = ids[s : s + 2048]
            want[i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
            rests.append(len(piece))
    rows = Q.op10_packing(spark, write(spark, tmp_path, texts)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
    assert sorted(2048 - sum(n for _, n in w) for w in windows.values()) == brute_best_fit(rests, 2048)
