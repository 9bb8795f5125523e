"""Operators without SQL against second, plain versions of themselves."""

import hashlib
import hmac
import itertools
import re
import time
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from palimpsest.llm import bpe, jaccard, langid, licenses, lines, pii, quality, queries, tiff
from test_operators import components

SCHEMA = "doc_id bigint, text string"


def stored(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "d"))
    return spark.read.schema(schema).parquet(str(tmp_path / "d"))


def test_jaccard_with_repeated_and_null_keys(spark, data, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    base = rows[5][1]
    rows += [(7, base), (7, "other words of the same key here now"), (None, base + " more"), (None, None), (None, "x y z"), (3, rows[9][1]), (3, rows[9][1])]
    component, keys = components(dict(enumerate(t for _, t in rows))), defaultdict(list)
    for i, (k, _) in enumerate(rows):
        keys[component[i][1]] += [k] if k is not None else []
    want = [(k, component[i][0], min(keys[component[i][1]], default=None) if component[i][0] else k) for i, (k, _) in enumerate(rows)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(stored(spark, tmp_path, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


class Plain:
    """Pseudonyms of single values, in plain Python."""

    def __init__(self, key):
        self.key = key

    def keyed(self, kind, *parts):
        own = hmac.new(self.key.encode(), kind.encode(), hashlib.sha256).hexdigest()
        return hmac.new(own.encode(), "|".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()

    def feistel(self, a, b, size_a, size_b, kind):
        for i in range(pii.ROUNDS):
            if i % 2 == 0:
                a = (a + int(self.keyed(kind, i, b)[:14], 16) % size_a) % size_a
            else:
                b = (b + int(self.keyed(kind, i, a)[:14], 16) % size_b) % size_b
        return a, b

    def ip(self, m):
        p = [int(x) for x in m.split(".")]
        a, b = self.feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def ssn(self, m):
        area, group, serial = map(int, m.split("-"))
        area = area - 2 if area > 666 else area - 1
        a, b = self.feistel(area * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        area = a // 99
        return f"{area + 2 if area > 664 else area + 1:03d}-{a % 99 + 1:02d}-{b + 1:04d}"

    def phone(self, m):
        d = re.sub("[^0-9]", "", m)[-10:]
        a, b = self.feistel((int(d[:3]) - 200) * 100 + int(d[6:8]), (int(d[3:6]) - 200) * 100 + int(d[8:]), 80_000, 80_000, "phone")
        new = iter(("1" if m.startswith("+") else "") + f"{a // 100 + 200:03d}{b // 100 + 200:03d}{a % 100:02d}{b % 100:02d}")
        return "".join(next(new) if c.isdigit() else c for c in m)

    def day(self, m):
        n = (date.fromisoformat(m) - date(1800, 1, 1)).days
        place = n % pii.CYCLE
        a, b = self.feistel(place // pii.CYCLE_B, place % pii.CYCLE_B, pii.CYCLE_A, pii.CYCLE_B, "date")
        return str(date(1800, 1, 1) + timedelta(n - place + a * pii.CYCLE_B + b))

    def card(self, m):
        d = re.sub("[^0-9]", "", m)
        left = (len(d) - 2) // 2
        right = len(d) - 2 - left
        a, b = self.feistel(int(d[1 : 1 + left]), int(d[1 + left : -1]), 10**left, 10**right, "card")
        body = f"{d[0]}{a:0{left}d}{b:0{right}d}"
        total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(body + "0")))
        new = iter(body + str(-total % 10))
        return "".join(next(new) if c.isdigit() else c for c in m)

    def email(self, m):
        return f"u{self.keyed('name', m.lower())[:12]}@d{self.keyed('domain', m.split('@')[1].lower())[:8]}.invalid"

    def secret(self, m):
        head, value = re.match("(.*[=:] *)(.*)", m).groups()
        return head + (self.keyed("secret0", value) + self.keyed("secret1", value))[: len(value)]


def test_pseudonyms_equal_a_plain_version(spark):
    plain, rng = Plain("some key"), np.random.default_rng(11)
    values = {
        "ip": ["10.0.0.1", "255.255.0.9", "9.8.7.6"], "ssn": ["123-45-6789", "667-01-0001", "899-99-9999"], "phone": ["+1 (244) 555-4688", "212-555-0123", "(212) 555-0123"],
        "day": ["2024-02-29", "1999-12-31", "1800-01-01", "1066-10-14"], "card": ["4428353510103350", "4428 3535 1010 3350"], "email": ["Ann.Lee@Mail1.example.com", "x@y.org"], "secret": ["password: hunter2-long", "token=deadbeefdeadbeef"],
    }
    flat = [(kind, v) for kind, own in values.items() for v in own]
    texts, want = [], []
    for _ in range(60):
        picked = [flat[i] if i < len(flat) else ("word", f"word{'s' * (i % 5)}") for i in rng.integers(0, 2 * len(flat), 12)]
        texts.append(" so ".join(v for _, v in picked))
        want.append(" so ".join(v if kind == "word" else getattr(plain, kind)(v) for kind, v in picked))
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = pii.pseudonymise(df, "some key")
    assert [r["text"] for r in found.orderBy("doc_id").collect()] == want
    assert "some key" not in found._jdf.queryExecution().toString()
    clash = df.select("doc_id", "text", F.lit("k").alias("kinds"), F.lit("f").alias("_found"), F.lit("t").alias("_text"))
    again = pii.pseudonymise(clash, "some key", keep=tuple(clash.columns))
    assert [r["text"] for r in again.orderBy("doc_id").collect()] == want and again.first()["_found"] == "f"


def plain_lines(texts, least=5, share=0.6, leading=3, min_tokens=4):
    """Templates leaf by leaf with dictionaries; gives the texts that are left."""
    digit = lambda t: any(c.isdigit() for c in t)
    enough = lambda fixed, n: sum(fixed) / n >= share and 3 * sum(fixed[leading:]) >= n - leading
    of_line, documents, leaves = {}, defaultdict(set), defaultdict(set)
    for d, text in texts.items():
        for line in (text or "").split("\n"):
            tokens = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not tokens:
                continue
            masked = tuple("#" if digit(t) else t for t in tokens)
            is_open = len(tokens) >= min_tokens and enough([m != "#" for m in masked], len(tokens))
            name = ("open", masked) if is_open else ("real", tokens)
            of_line[line] = name
            documents[name].add(d)
            if is_open:
                leaves[(len(tokens), masked[:leading])].add(name)
    template = {name: name for name in documents}
    for leaf, names in leaves.items():
        in_leaf = sum(len(documents[n]) for n in names)
        have = Counter()
        for n in names:
            for p, t in enumerate(n[1]):
                have[p, t] += len(documents[n]) if t != "#" else 0
        left, part = set(names), 0.5
        while left:
            limit = max(least, part * in_leaf)
            groups = defaultdict(list)
            for n in left:
                fixed = [have[p, t] >= limit for p, t in enumerate(n[1])]
                if enough(fixed, len(n[1])):
                    groups[(leaf, tuple(t if f else None for t, f in zip(n[1], fixed)))].append(n)
            for g, own in groups.items():
                if sum(len(documents[n]) for n in own) >= least:
                    for n in own:
                        template[n] = g
                        left.discard(n)
            if limit <= least:
                break
            part /= 2
    together = defaultdict(set)
    for n, t in template.items():
        together[t] |= documents[n]
    gone = lambda d, line: line in of_line and len(own := together[template[of_line[line]]]) >= least and d != min(own)
    out = {}
    for d, text in texts.items():
        if text is None:
            out[d] = None
            continue
        pieces = text.split("\n")
        kept = "".join(p + ("\n" if i < len(pieces) - 1 else "") for i, p in enumerate(pieces) if not gone(d, p))
        out[d] = kept
    return out


def test_lines_equal_a_plain_version(spark, data, tmp_path):
    rng = np.random.default_rng(2)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    names = ["ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal"]
    for k in range(120):
        a, b, c = rng.choice(names, 3)
        texts[1000 + k] = "\n".join([f"user {a} logged in from {b} at {k}", f"the {a} of {b} is with {c} today", "Read more", f"{k} {k + 1} 7 8", "", f"own line {names[k % 8]} number w{k}", "plain end"][: rng.integers(1, 8)])
    texts[2000], texts[2001] = None, ""
    cut = lines.drop_recurring_lines(stored(spark, tmp_path, list(texts.items())))
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got == plain_lines(texts) and got != texts
    again = lines.drop_recurring_lines(stored(spark, tmp_path / "again", [tuple(r) for r in cut.collect()], f"{SCHEMA}, n_lines_dropped bigint"))
    assert again.columns == cut.columns and again.count() == cut.count()


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(40):
        scores = -rng.exponential(3, (6, 3)).round(3)
        best = max(sum(scores[t, x] for t, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:])) for path in itertools.product(range(3), repeat=6))
        for path in (langid.viterbi(scores, 2.0), langid.label_spans(scores - scores.max(axis=1, keepdims=True), 2.0)):
            value = sum(scores[t, x] for t, x in enumerate(path)) - 2.0 * np.count_nonzero(np.diff(path))
            assert abs(value - best) < 1e-9


def test_word_scores_equal_a_plain_version(spark):
    rows = [(k, ["the cat and dog", "der hund und katze", "кот и пёс"][k % 3] + f" {('абвгдеж' if k % 3 == 2 else 'abcdefg')[k % 7]}", ["en", "de", "ru"][k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, lang string")
    model = langid.train(df)
    assert model.languages == ["de", "en", "ru"]
    learned = [(t, l) for k, t, l in rows if zlib.crc32(str(k).encode()) % 4 != 2]

    def bucket(word, at, order):
        value = ord(word[at]) + 1
        for j in range(1, order):
            value = (value * 1_000_003 + (ord(word[at - j]) + 1 if at - j >= 0 else 0)) % 2**64
        return (value * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BUCKETS_LOG2)

    tables = [defaultdict(lambda: dict.fromkeys(model.languages, langid.SMOOTHING)) for _ in langid.ORDERS]
    totals = [dict.fromkeys(model.languages, langid.SMOOTHING * 2**langid.BUCKETS_LOG2) for _ in langid.ORDERS]
    for text, lang in learned:
        for word in text.split():
            for o, order in enumerate(langid.ORDERS):
                for at in range(len(word)):
                    tables[o][bucket(word, at, order)][lang] += 1
                    totals[o][lang] += 1
    word = "hund"
    own = {lang: sum(np.log(tables[o][bucket(word, at, order)][lang] / totals[o][lang]) for o, order in enumerate(langid.ORDERS) for at in range(len(word))) / len(langid.ORDERS) for lang in ("de", "en")}
    data = np.frombuffer(word.encode(), np.uint8)
    got = langid.word_scores(langid.words_of(data, np.array([0, len(data)])), model)[0]
    assert got[2] == -np.inf and abs((got[1] - got[0]) - (own["en"] - own["de"])) < 1e-4
    many = spark.createDataFrame([(k, f"word{chr(97 + k % 26)}{chr(97 + k // 26)} text", f"l{k:03d}") for k in range(400)], f"{SCHEMA}, lang string")
    assert len(langid.train(many).languages) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(400))


def test_media_query_equals_a_plain_version(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    files = {r["doc_id"]: bytes(r["media"]) for r in tiff.tiff_encode(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    for r in queries.op8_tiff(spark, data).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        page = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        p = np.bincount(page.ravel() >> 4, minlength=16) / page.size
        entropy = -sum(x * np.log2(x) for x in p if x)
        feature = f"64x{len(page)};mean={page.mean():.4f};std={page.std():.4f};step={np.abs(np.diff(page.astype(int), axis=1)).mean():.4f};entropy={entropy:.4f}"
        file = files[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest()) and r["feature"] == feature


def test_damaged_media(spark):
    whole = tiff.write_tiff([np.arange(640, dtype=np.uint8).reshape(10, 64), np.ones((4, 64), np.uint8)])

    def with_field(tag, value, page=0):
        out = bytearray(whole)
        at = int.from_bytes(out[4:8], "little")
        for _ in range(page):
            at = int.from_bytes(out[at + 2 + 12 * out[at] : at + 6 + 12 * out[at]], "little")
        for k in range(out[at]):
            where = at + 2 + 12 * k
            if int.from_bytes(out[where : where + 2], "little") == tag:
                out[where + 8 : where + 12] = value.to_bytes(4, "little")
        return bytes(out)

    files = [
        whole, None, b"", b"II*\0", whole[:60], b"MM" + whole[2:], with_field(tiff.TAG_ROWS_PER_STRIP, 0), with_field(tiff.TAG_LENGTH, 2**31), with_field(tiff.TAG_WIDTH, 0), with_field(tiff.TAG_STRIP_OFFSETS, 2**31),
        with_field(tiff.TAG_COMPRESSION, 99), with_field(tiff.TAG_BITS, 16), with_field(tiff.TAG_STRIP_OFFSETS, 2**31, page=1), bytes(range(256)),
    ]
    df = spark.createDataFrame([(k, f, "own", 5) for k, f in enumerate(files)], "doc_id bigint, media binary, error string, page int")
    got = defaultdict(list)
    for r in tiff.tiff_pages(df).collect():
        got[r["doc_id"]].append((r["page"], r["error"] is None, r["samples"] is None))
    assert got[0] == [(0, True, False), (1, True, False)] and got[12] == [(0, True, False), (1, False, True)]
    assert all(got[k] == [(0, False, True)] for k in range(1, len(files)) if k != 12)


def test_quality_equals_a_direct_solution(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = docs.select("doc_id", (F.length("text") % 2).alias("quality"))
    stats = quality.document_statistics(docs)
    model = quality.train(stats, labels, n_features=24)
    rows = labels.join(stats, "doc_id").select("doc_id", "quality", "stats", (F.pmod(F.xxhash64("doc_id"), F.lit(quality.CALIBRATION_SHARE)) == 0).alias("calibrates")).collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    x = np.array([np.frombuffer(r["stats"], np.float64) for r in rows])
    y, calibrates = np.array([r["quality"] for r in rows], float), np.array([r["calibrates"] for r in rows])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.scale, np.sqrt(np.maximum(x.var(axis=0), 1e-8)), atol=1e-6)
    z = model.features(x[~calibrates])
    penalty = np.full(z.shape[1], quality.RIDGE * len(z))
    penalty[0] = 0
    assert np.allclose(model.ridge, np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y[~calibrates]), atol=1e-5)
    raw = model.raw_scores(x[calibrates])
    place = np.clip(((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(place.tolist()))
    weight = np.array([np.count_nonzero(place == b) for b in bins], float)
    value = np.array([y[calibrates][place == b].mean() for b in bins])
    mean = lambda i, j: (weight[i:j] * value[i:j]).sum() / weight[i:j].sum()
    isotonic = [max(min(mean(i, j) for j in range(k + 1, len(bins) + 1)) for i in range(k + 1)) for k in range(len(bins))]
    assert np.allclose(model.level, isotonic)


def test_fuzzy_notices_equal_a_search_without_seeds():
    rng = np.random.default_rng(9)
    notices = {"released under the mit license": "mit", "all rights reserved": "all-rights-reserved"}
    scanner = licenses.Scanner({}, notices)
    for _ in range(80):
        words = [f"w{i}" for i in rng.integers(0, 50, 40)]
        planted = list(list(notices)[rng.integers(2)])
        for _ in range(rng.integers(0, 5)):
            at = rng.integers(len(planted))
            planted[at : at + rng.integers(0, 2)] = list("xyz")[: rng.integers(0, 2)]
        at = rng.integers(len(words))
        text = " ".join([*words[:at], "".join(planted), *words[at:]])
        got = {m.label for m in scanner.scan(text)}
        want = {label for n, label in notices.items() if regex.search(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={max(1, len(n) // 10)}}}", text)}
        assert got == want


def test_license_scan_grows_with_the_text():
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.NOTICES)
    one = "released under the mit license all rights reserved licensed under cc by nc 4 0 and so on "
    seconds = []
    for n in (500, 5000):
        began = time.perf_counter()
        found = scanner.scan(one * n)
        seconds.append(time.perf_counter() - began)
        assert sum(m.exact and m.label == "mit" for m in found) == n
    assert seconds[1] < 25 * seconds[0]


def test_long_texts_are_encoded_as_ever(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANK_FILE, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    texts = [" ".join(f"Word{i}'ll être {i * 7}" for i in rng.integers(0, 9999, 9000)), "abcdefghij" * 3000, "\n \n" * 9000, None]
    df = spark.createDataFrame([(k, t, "x", b"y") for k, t in enumerate(texts)], f"{SCHEMA}, _text string, token_ids binary")
    both = bpe.bpe_decode(bpe.bpe_encode(df, queries.RANK_FILE, keep=tuple(df.columns)), queries.RANK_FILE)
    once = {r["doc_id"]: (bytes(r["token_ids"]), bytes(r["decoded"])) for r in bpe.bpe_round_trip(df, queries.RANK_FILE).collect()}
    for r in both.collect():
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == known.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["_text"] == "x"
        assert once[r["doc_id"]] == (bytes(r["token_ids"]), bytes(r["decoded"]))
