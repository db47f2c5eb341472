"""The corpus operators against brute force, on a fixture with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from pagewright.llm import gif, line_dedup, mixing, near_dedup, packing, pii, quality, sharding, suffix_dedup, toxicity
from pagewright.llm.suffix_array import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- near duplicates ------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_near_duplicates(docs, corpus):
    sets = {r[0]: shingles(r[1]) for r in corpus if r[0] is not None}
    want = components(sets)
    got = rows(near_dedup.near_duplicates(docs))
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["kept"]


def test_near_duplicates_without_a_common_centre(spark, words):
    """Groups whose members are near some others only: links must not depend on the representative, nor on one block."""
    rng = random.Random(5)
    base = [rng.choice(words) for _ in range(60)]
    data = []
    for k in range(260):
        w = list(base)
        for i in rng.sample(range(60), rng.randint(1, 4)):
            w[i] = rng.choice(words)
        data.append((k, " ".join(w)))
    sets = {d: shingles(t) for d, t in data}
    want = components(sets)
    assert 1 < len(set(want.values())) < 260
    old, near_dedup.BLOCK = near_dedup.BLOCK, 50
    try:
        got = rows(near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    finally:
        near_dedup.BLOCK = old
    wrong = [r["doc_id"] for r in got if r["component_id"] != want[r["doc_id"]]]
    assert len(wrong) <= 2, wrong  # a pair just at 0.75 is met with probability 0.99998


def test_one_of_each_group_and_empty_table(docs, corpus, none):
    kept = [r["doc_id"] for r in rows(near_dedup.one_of_each_group(docs))]
    want = components({r[0]: shingles(r[1]) for r in corpus if r[0] is not None})
    assert Counter(kept) == Counter([*set(want.values()), None])
    assert near_dedup.near_duplicates(none).count() == 0


def test_several_texts_under_one_id_or_none(spark, words):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(5))
    near = lambda t: t + " " + words[0]
    data = [(None, a), (None, b), (None, near(b)), (None, e), (None, e), (None, ""), (7, a), (5, c), (5, d), (3, near(c)), (9, near(d)), (5, d.upper()), (5, d)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    text = {r["th"]: r["text"] for r in rows(df.selectExpr("text", "xxhash64(text) AS th"))}
    got = {(r["doc_id"], text[r["th"]]): r for r in rows(near_dedup.near_duplicates(df))}
    want = {(None, a): 7, (7, a): 7, (None, b): None, (None, near(b)): None, (None, e): None, (None, ""): None, (5, c): 3, (3, near(c)): 3, (5, d): 5, (5, d.upper()): 5, (9, near(d)): 5}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert got[7, a]["kept"] and got[3, near(c)]["kept"] and got[None, e]["kept"] and got[None, ""]["kept"]
    assert got[None, b]["kept"] != got[None, near(b)]["kept"] and got[5, d]["kept"] != got[5, d.upper()]["kept"]
    left = Counter((r["doc_id"], r["text"]) for r in rows(near_dedup.one_of_each_group(df)))
    assert left == Counter(k for k, r in got.items() if r["kept"]) and sum(left.values()) == 6


# -- media ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [2, 3, 8])
def test_lzw_round_trip(bits):
    rng = random.Random(bits)
    for n in (0, 1, 2, 300, 5000, 40000):
        for alphabet in (1, 2, 1 << bits):
            data = bytes(rng.randrange(min(alphabet, 1 << bits)) for _ in range(n))
            assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n).tobytes() == data


def plain_lzw(data, size):
    """A decoder by the book, code by code."""
    clear, bit, out = 1 << size, 0, []
    table, width, last = None, size + 1, None
    value = int.from_bytes(data, "little")
    while True:
        code = (value >> bit) & ((1 << width) - 1)
        bit += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [None, None], size + 1, None
            continue
        if code == clear + 1:
            return b"".join(out)
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry


def test_lzw_against_a_plain_decoder():
    data = Path(__file__).read_bytes() * 3
    assert plain_lzw(gif.lzw_encode(data, 8), 8) == data


def test_frames_disposal_transparency_and_interlace():
    pal = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    f = lambda idx, left, top, disposal, transparent: gif.Frame(left, top, len(idx[0]), len(idx), np.array(idx, np.uint8).ravel(), pal, 5, disposal, transparent)
    frames = [f([[1, 1], [1, 1]], 0, 0, 1, None), f([[2]], 0, 0, 3, None), f([[3, 0]], 0, 1, 2, 0), f([[2]], 1, 1, 0, None)]
    g = gif.read_gif(gif.write_gif(frames, 2, 2))
    seen = [c[..., :3].tolist() for c in gif.canvases(g)]
    red, green, blue, gone = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert seen[0] == [[red, red], [red, red]]
    assert seen[1] == [[green, red], [red, red]]
    assert seen[2] == [[red, red], [blue, red]]  # the frame before was restored; index 0 lets through
    assert seen[3] == [[red, red], [gone, green]]  # the frame before was cleared
    rows8 = [[k % 4] * 3 for k in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    data = gif.write_gif([f([rows8[k] for k in order], 0, 0, 0, None)], 3, 9)
    at = data.index(b"\x2c", data.index(b"\x21\xf9\x04") + 8) + 9
    data = data[:at] + bytes([data[at] | 0x40]) + data[at + 1 :]
    assert gif.read_gif(data).frames[0].indices.tolist() == rows8
    for bad in (b"", b"PNG", data[:40], b"GIF89a"):
        with pytest.raises(ValueError):
            gif.read_gif(bad)


def test_broken_files_raise_value_errors_only():
    rng = random.Random(12)
    small = gif.gif_of_payload(gif.pad(b"some words of a text, some words"))
    for _ in range(3000):
        data = bytearray(small)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(6, len(data))] = rng.randrange(256)
        try:
            g = gif.read_gif(bytes(data[: rng.randint(10, len(data))]))
        except ValueError:
            continue
        assert sum(f.indices.size for f in g.frames) < gif.MOST_PIXELS
    huge = small[:6] + b"\xff\xff\xff\xff" + small[10:]
    with pytest.raises(ValueError):
        gif.read_gif(huge)


def test_media_columns(docs, corpus, none):
    got = rows(gif.media_features(gif.encode_texts(docs), ["doc_id", "n_bytes"]))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(corpus)
    for d, t, *_ in corpus:
        raw = (t or "").encode()
        want = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = by[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    frames = rows(gif.timed_frames(gif.encode_texts(docs), "doc_id"))
    assert sum(r["histogram"][0] >= 0 for r in frames) == len(frames) and max(r["frame"] for r in frames) > 0
    assert gif.media_features(gif.encode_texts(none), ["doc_id"]).count() == 0


def test_media_and_features_against_plain_reading(docs, corpus):
    """Every stored file, taken apart by hand: its header, its code streams by the book, and its colours counted one by one."""
    stored = rows(gif.media_features(gif.encode_texts(docs), ["doc_id", "media"]))
    for r in stored[::9]:
        media = bytes(r["media"])
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["media_bytes"] == len(media)
        width, height, flags = int.from_bytes(media[6:8], "little"), int.from_bytes(media[8:10], "little"), media[10]
        at, palette = 13 + 3 * (2 << (flags & 7)), media[13 : 13 + 3 * (2 << (flags & 7))]
        pixels, frames, ms = b"", 0, 0
        while media[at] != 0x3B:
            if media[at] == 0x21:
                if media[at + 1] == 0xF9:
                    ms += 10 * int.from_bytes(media[at + 4 : at + 6], "little")
                at += 2
            else:
                assert media[at] == 0x2C
                frames += 1
                size, at, code = media[at + 10], at + 11, b""
                while media[at]:
                    code, at = code + media[at + 1 : at + 1 + media[at]], at + 1 + media[at]
                pixels, at = pixels + plain_lzw(code, size), at + 1
                continue
            while media[at]:
                at += 1 + media[at]
            at += 1
        assert r["payload_sha256"] == hashlib.sha256(pixels).hexdigest()
        colours = Counter(sum((palette[3 * v + c] >> 6) << (4 - 2 * c) for c in range(3)) for v in pixels)
        assert r["feature"] == f"{width}x{height};frames={frames};ms={ms};hist=" + ",".join(f"{k}:{colours[k]}" for k in sorted(colours))


def test_a_file_without_frames_and_code_sizes_beyond_the_format(spark):
    none = gif.write_gif([], 3, 2)
    wide = bytearray(gif.gif_of_payload(gif.pad(b"x")))
    at = wide.index(b"\x2c", 13 + 768)
    wide[at + 10] = 9
    got = rows(gif.media_features(spark.createDataFrame([(1, none), (2, bytes(wide)), (3, None)], "doc_id long, media binary"), ["doc_id"]))
    by = {r["doc_id"]: r for r in got}
    assert by[1]["payload_bytes"] == 0 and by[1]["feature"] == "3x2;frames=0;ms=0;hist=" and by[1]["payload_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[2]["feature"] is None and by[3]["feature"] is None
    frames = gif.timed_frames(spark.createDataFrame([(1, none), (1, none)], "doc_id long, media binary"), "doc_id")
    assert frames.count() == 0 and gif.timed_frames(spark.createDataFrame([], "doc_id long, media binary"), "doc_id").count() == 0


# -- sharding -------------------------------------------------------------------------------------------------


def test_sharding(docs, corpus, none):
    got = rows(sharding.shard_by_bytes(docs))
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in corpus}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size[r[0]]) for r in corpus)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(none).count() == 0


def test_sharding_is_even_and_splits_a_hot_text(spark):
    data = [(k, "same text over and over" if k % 3 == 0 else f"text number {k} " * (1 + k % 9)) for k in range(6000)]
    got = rows(sharding.shard_by_bytes(spark.createDataFrame(data, "doc_id long, text string")))
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(abs(v - mean) for v in size.values()) < 0.03 * mean
    old, sharding.PART_ROWS = sharding.PART_ROWS, 100  # several parts a shard
    try:
        again = rows(sharding.shard_by_bytes(spark.createDataFrame(data, "doc_id long, text string")))
    finally:
        sharding.PART_ROWS = old
    by = defaultdict(list)
    for r in again:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 16


def test_shards_hold_equal_texts_together_and_in_order(spark, docs, corpus, monkeypatch):
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus)
    for part_rows in (2_000_000, 3):
        monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
        got = rows(sharding.shard_by_bytes(docs))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        # slots of a shard run through the hash order: a text's rows are neighbours, by doc_id, unknown ids first
        line = sorted(got, key=lambda r: (r["shard"], r["slot"]))
        assert [(r["shard"], r["slot"]) for r in line] == [(s, k) for s in range(16) for k in range(sum(r["shard"] == s for r in got))]
        crcs = [r["text_crc32"] for r in line]
        runs = [c for k, c in enumerate(crcs) if k == 0 or crcs[k - 1] != c]
        assert len(runs) == len(set(runs))
        for a, b in zip(line, line[1:], strict=False):
            if a["text_crc32"] == b["text_crc32"]:
                assert a["doc_id"] is None or (b["doc_id"] is not None and a["doc_id"] <= b["doc_id"])
    query = sharding.shard_by_bytes(docs).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in query} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows(sharding.shard_by_bytes(docs))}


def test_thousands_of_parts(spark, monkeypatch):
    rng = random.Random(14)
    data = [(rng.choice([None, k, k % 50, -k, 2**62 - k]), "hot" if k % 3 == 0 else f"text {k % 1500} " * (1 + k % 5)) for k in range(5000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    plain = rows(sharding.shard_by_bytes(df, tolerance=0.0, group_tolerance=0.0))
    monkeypatch.setattr(sharding, "PART_ROWS", 1)
    monkeypatch.setattr(sharding, "BINS", 1 << 12)
    got = rows(sharding.shard_by_bytes(df, tolerance=0.0, group_tolerance=0.0))
    key = lambda r: tuple((x is not None, x or 0) for x in (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]))
    assert sorted(map(key, got)) == sorted(map(key, plain))
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 16
    assert len(size) == 16 and all(abs(v - mean) <= 100 for v in size.values())  # a text is up to 50 bytes


# -- personal data --------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_against_the_patterns():
    rng = random.Random(1)
    for _ in range(30000):
        t = "".join(rng.choice("a1.2@-+ (30") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("contact john at example dot com ok", "email", "john at example dot com"),
        ("jоhn@example.com here", "email", "jоhn@example.com"),
        ("＋１ (４１４) 555-7134", "phone", "＋１ (４１４) 555-7134"),
        ("plus one four one four five five five seven one three four end", "phone", "plus one four one four five five five seven one three four"),
        ("ip one nine two dot one six eight dot zero dot one x", "ip", "one nine two dot one six eight dot zero dot one"),
        ("pay 4539578763621486 or four five three nine five seven eight seven six three six two one four eight six", "card", "four five three nine five seven eight seven six three six two one four eight six"),
        ("a​b@example.com", "email", "a​b@example.com"),
    ],
)
def test_disguises(text, kind, part):
    base = pii.base_spans(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in pii.added_spans(text, base)
    assert base == plain_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("pay 4539\u00a05787\u00a06362\u00a01486 now", "card", "4539\u00a05787\u00a06362\u00a01486"),
        ("call +49\u00a030\u00a01234567 now", "phone", "+49\u00a030\u00a01234567"),
        ("mail j\u0131m@example.com now", "email", "j\u0131m@example.com"),
        ("call plus 49 30 1234567 now", "phone", "plus 49 30 1234567"),
        ("pay four 5 three 9 five 7 eight 7 six 3 six 2 one 4 eight 6 now", "card", "four 5 three 9 five 7 eight 7 six 3 six 2 one 4 eight 6"),
    ],
)
def test_disguises_that_stand_alone(text, kind, part):
    assert (kind, text.index(part), text.index(part) + len(part)) in pii.added_spans(text, pii.base_spans(text))


def test_disguises_do_not_depend_on_each_other():
    rng = random.Random(3)
    bits = ["4539", "5787", "6362", "1486", "\u00a0", " ", "-", "+49", "plus", "30", "1234567", "one", "Two", "drei", "cinq", "5", "j\u0131m", "@", "at", "example", ".", "dot", "com", "\uff11", "\u200b", "(at)", "word", ",", "<"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) + rng.choice(["", " ", " ", "\u00a0"]) for _ in range(rng.randint(1, 30)))
        alone = pii.added_spans(t, pii.base_spans(t))
        beside = t + "#\u200b"  # a plain disguise behind it
        assert alone == pii.added_spans(beside, pii.base_spans(beside)), t


def test_no_disguise_is_overlooked():
    """disguised() holds wherever the transducers change a text."""
    rng = random.Random(5)
    bits = ["4539", " ", " ", "-", "+49", "plus", "Plus", "one", "Two", "drei", "cinq", "five", "un", "uno", "j\u0131m", "@", "at", "AT", "example", ".", "dot", "punkt", "com", "\uff11", "\u200b", "(at)", "( at )", "[ @]", "{.}", "<dot>", "word", ",", "<"]
    bits += ["\xe4t", "Arobase", "\u017feven", "\u017fEIS", "c\u0130nco", "\u212a", "\xe9", "_", "\n", "z\xe9ro", "f\xfcnf", "5", "\u00a0"]
    seen = Counter()
    for _ in range(20_000):
        t = "".join(rng.choice(bits) + rng.choice(["", "", " ", " ", "\t"]) for _ in range(rng.randint(1, 9)))
        changed = "".join(pii.normalise(t).parts) != t
        assert pii.disguised(t) or not changed, t
        seen[changed, pii.disguised(t)] += 1
    assert min(seen[True, True], seen[False, False]) > 1000


def test_planted_disguises_are_found():
    """Recall over random disguises of random identifiers."""
    rng = random.Random(11)
    digit = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    word = lambda: "".join(rng.choice("bcdfgklmprst") for _ in range(6))
    found = n = 0
    for _ in range(2000):
        kind = rng.choice(["email", "ip", "phone"])
        if kind == "email":
            a, b = word(), word()
            plant = rng.choice([f"{a} [at] {b} [dot] com", f"{a} at {b} dot com", f"{a}\u200b@{b}.com", f"{a}(at){b}.com", f"{a} @ {b}.com", f"{a}@{b}.com".replace("c", "\u0441", 1)])
        elif kind == "ip":
            parts = [str(rng.randint(1, 255)) for _ in range(4)]
            plant = rng.choice([" dot ".join(" ".join(digit[int(c)] for c in p) for p in parts), " dot ".join(parts), "[.]".join(parts), ".".join(parts).translate({48 + k: 0xFF10 + k for k in range(10)})])
        else:
            d = "".join(rng.choice("123456789") for _ in range(11))
            plant = rng.choice(["plus " + " ".join(digit[int(c)] for c in d), "plus " + d, "+" + "\u00a0".join([d[:2], d[2:5], d[5:]]), "\uff0b" + d])
        t = f"{word()} {word()}, {plant} , {word()}"
        s = t.index(plant)
        n += 1
        found += any(k == kind and a <= s and z >= s + len(plant) - 1 for k, a, z in pii.added_spans(t, pii.base_spans(t)))
    assert found / n > 0.97, found / n


@pytest.mark.parametrize("text", ["", "look at the one two house", "meet me at example.com", "un deux trois quatre", "Die drei vier fünf sechs Leute", "x@y", "1.2.3", "a (at) b"])
def test_clean_texts_stay_clean(text):
    assert pii.added_spans(text, pii.base_spans(text)) == []


def test_pii_columns(docs, corpus, none):
    got = {r["doc_id"]: r for r in rows(pii.find_pii(docs))}
    for d, t, *_ in corpus:
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t or ""))
        assert got[d]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert pii.find_pii(none).count() == 0


# -- quality --------------------------------------------------------------------------------------------------


def plain_quality(t):
    t = t or ""
    w = WORD.findall(t)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts(docs, corpus, none):
    got = {r["doc_id"]: r for r in rows(quality.quality_verdicts(docs))}
    for d, t, *_ in corpus:
        n = plain_quality(t)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_verdicts(none).count() == 0


def test_adaptive_fences(spark, words):
    rng = random.Random(4)
    data = []
    for k in range(900):
        w = [rng.choice(words) for _ in range(80)]
        lang = "aa" if k % 2 else "bb"
        if lang == "bb":  # a group where some symbols are normal
            w = [x + ("#" if rng.random() < 0.3 else "") for x in w]
        if k % 100 == 99:
            w = [x + "###" for x in w]
        data.append((k, " ".join(w), lang, "s", 0))
    got = rows(quality.quality_verdicts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")))
    assert {r["doc_id"] for r in got if not r["kept"]} == {k for k in range(900) if k % 100 == 99}


def test_quality_filter(spark, docs, words, none):
    """The filter keeps whole rows; null groups have fences; equal texts of other groups are judged by their own."""
    rng = random.Random(14)
    text = lambda mark: " ".join(rng.choice(words) + mark * (rng.random() < 0.4) for _ in range(90))
    data = [(k, text("#" if k % 2 else ""), None, "marked" if k % 2 else None, k) for k in range(600)]
    odd = text("##")
    data += [(600, odd, None, None, 0), (600, odd, None, "marked", 1), (601, "few words", None, None, 2), (602, None, None, None, 3), (None, data[0][1], None, None, 4), data[2], data[2]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, row long")
    left = quality.quality_filter(df)
    assert left.columns == df.columns and quality.quality_filter(none).count() == 0
    gone = df.exceptAll(left).collect()
    assert {(r["doc_id"], r["row"]) for r in gone} == {(600, 0), (601, 2), (602, 3)} and left.count() == len(data) - 3
    assert quality.quality_filter(docs).columns == docs.columns


def test_sketch_quantiles(spark):
    values = [(1, "l", "s", 0, v, 10, 0, 0, 0, 1, 0, 0) for v in range(1, 2001)]
    df = spark.createDataFrame(values, "doc_id long, lang string, source string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bang long")
    rules = quality.AdaptiveRules(metrics={"x": ("n_words", "word_chars", False, 0)}, min_words=0)
    q = quality.quantiles(quality.sketch(df, rules), ["lang"], rules).first()
    assert abs(q["q1"] - 50) < 1.1 and abs(q["q3"] - 150) < 3.1 and q["n_rows"] == 2000


# -- lines ----------------------------------------------------------------------------------------------------


def test_line_dedup(spark, none):
    data = [(k, f"own line {k}\n  shared banner \n\nsecond {k % 5}", "en", f"s{k % 12}", 0) for k in range(60)]
    data += [(100, None, None, None, 0), (101, "", "en", "s1", 0), (102, "shared banner\nshared banner", "en", None, 0)]
    got = {r["doc_id"]: r for r in rows(line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")))}
    assert got[0]["text"] == data[0][1]  # the first occurrence of each line stays
    assert all(got[k]["text"] == f"own line {k}\n" for k in range(5, 60))
    assert got[1]["text"] == "own line 1\n\nsecond 1"
    assert got[100]["text"] is None and got[101]["text"] == "" and got[102]["text"] == ""
    left = rows(line_dedup.without_emptied(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")))
    assert {r["doc_id"] for r in left} == {*range(60), 100, 101}
    assert line_dedup.dedup_lines(none).count() == 0


def plain_line_dedup(corpus, least=10):
    """Texts after line dedup, for each distinct (doc_id, text)."""
    sites, places = defaultdict(set), defaultdict(list)
    for doc, text, _, source, _ in corpus:
        for pos, line in enumerate((text or "").split("\n")):
            if k := line.strip(" \t\n\x0b\x0c\r"):
                sites[k].add(source)
                places[k].append((doc is not None, doc or 0, text, pos))
    gone = {p for k, found in places.items() if len(sites[k]) >= least for p in found if p != min(found)}
    return {(d, t): None if t is None else "\n".join(x for pos, x in enumerate(t.split("\n")) if (d is not None, d or 0, t, pos) not in gone) for d, t, *_ in corpus}


def test_line_dedup_of_odd_rows(spark, docs, corpus):
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_removed"]  # clashing names pass through
    data = [*corpus, *((5000 + k, f"a line on many sites\nown {k}\n" + "word " * (20_000 if k == 3 else 2), "en", f"s{k % 15}" if k else None, 0) for k in range(40))]
    data += [data[-1]] * 3 + [(None, "a line on many sites\nwithout an id", "en", "s1", 0)] * 2  # repeated rows lose the same lines
    want = plain_line_dedup(data)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_removed long").repartition(7)
    got = df.select("doc_id", "text").exceptAll(line_dedup.dedup_lines(df).select("doc_id", "text"))
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(df).select("doc_id", "text").collect()) == Counter((d, want[d, t]) for d, t, *_ in data)
    assert got.count() == sum(want[d, t] != t for d, t, *_ in data) > 40


def test_lines_near_the_threshold_are_counted_exactly(spark):
    data = [(10 * sites + k, f"line on {sites} sites", "en", f"s{k}", 0) for sites in range(5, 16) for k in range(sites)]
    got = rows(line_dedup.dedup_lines(spark.createDataFrame([(i, *d[1:]) for i, d in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")))
    gone = Counter(data[r["doc_id"]][1] for r in got if r["n_removed"])
    assert gone == {f"line on {n} sites": n - 1 for n in range(10, 16)}


# -- toxicity -------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, words, none):
    rng = random.Random(9)
    data, labels = [], []
    for k in range(1600):
        w = [rng.choice(words[:400]) for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for i in range(3):
                w[rng.randrange(60)] = rng.choice(["vilewordone", "vilewordtwo", "vilewordthree"])
        data.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*data, (5000, None), (5001, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.add_scores(docs, model, ["doc_id"]))}
    test = [(got[k], t) for k, t in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((s >= 0.3) == t for s, t in test) / len(test) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]
    lang = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert lang.prior == 0.0 and toxicity.add_scores(none, lang, ["doc_id"]).count() == 0


def test_the_fit_keeps_its_bounds(spark, words, monkeypatch):
    rng = random.Random(13)
    data = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(200)] + [(3, f"again {k}") for k in range(2000)] + [(k, " ".join(f"w{k}" for k in range(9000))) for k in range(1000, 1009)]
    labels = [(k, int(k < 60)) for k in range(200)] + [(3, 1)] * 50 + [(None, 1), (5, None)]
    seen = {}

    def fit(pos, unl, prior):
        seen.update(pos=pos, unl=unl)
        return toxicity.Model(prior, 0.0, {})

    monkeypatch.setattr(toxicity, "fit_nnpu", fit)
    df, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    learnt = {k for k in [*range(200), *range(1000, 1009)] if zlib.crc32(str(k).encode()) % 4 != 2}
    toxicity.train(df, lab, most_features=100)
    assert len(seen["pos"]) == len(learnt & set(range(60))) and len(seen["unl"]) == len(learnt)
    assert max(len(x) for x in seen["pos"] + seen["unl"]) == 100
    first = sorted(x.tobytes() for x in seen["pos"])
    toxicity.train(df.repartition(7), lab, positives=10, unlabelled=20, most_features=100)
    assert len(seen["pos"]) == 10 and len(seen["unl"]) == 20 and {x.tobytes() for x in seen["pos"]} <= set(first)


def test_risk_and_slopes_against_a_plain_computation():
    rng = np.random.default_rng(3)
    log_loss = lambda z, y: float(np.log1p(np.exp(-z if y else z)))
    seen = set()
    for _ in range(60):
        n_p, n_u, prior = int(rng.integers(1, 6)), int(rng.integers(1, 9)), float(rng.uniform(0.02, 0.6))
        z = rng.normal(-1, 3, n_p + n_u)
        plus = prior * sum(log_loss(x, True) for x in z[:n_p]) / n_p
        minus = lambda z, p=prior, a=n_p, b=n_u: sum(log_loss(x, False) for x in z[a:]) / b - p * sum(log_loss(x, False) for x in z[:a]) / a
        whole = lambda z, p=prior, a=n_p, m=minus: p * sum(log_loss(x, True) for x in z[:a]) / a + m(z)
        got = toxicity.risk(z, n_p, prior)
        assert np.allclose(got, (plus, minus(z)))
        f = whole if minus(z) >= 0 else lambda z, m=minus: -m(z)
        seen.add(minus(z) >= 0)
        by_steps = [(f(z + 1e-5 * e) - f(z - 1e-5 * e)) / 2e-5 for e in np.eye(len(z))]
        assert np.allclose(toxicity.slopes(z, n_p, prior), by_steps, atol=1e-6)
    assert seen == {True, False}


def test_scores_of_odd_rows(docs, corpus, none):
    model = toxicity.Model(0.1, -2.0, {zlib.crc32(w.encode()) & ((1 << toxicity.BITS) - 1): 0.1 + k / 7 for k, w in enumerate(["one", "two", "three", "four", "a", "b", "c"])})
    got = rows(toxicity.add_scores(docs, model, ["doc_id", "key"]))
    want = [1 / (1 + np.exp(-(-2.0 + sum(x for w, x in zip(["one", "two", "three", "four", "a", "b", "c"], model.weights.values(), strict=True) if w in set(re.sub(r"[\W_]+", " ", (t or "").lower()).split()))))) for _, t, *_ in corpus]
    assert np.allclose(sorted(r["score"] for r in got), sorted(want)) and {r["key"] for r in got} == {"clash"}
    assert toxicity.add_scores(none, model, ["doc_id"]).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, words):
    data = [(k, " ".join(words[k % 50 : k % 50 + 20])) for k in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    a = [(k, int(k % 7 == 0)) for k in range(400)]
    b = [(k, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, t in a]
    fit = lambda rows_: toxicity.train(docs, spark.createDataFrame(rows_, "doc_id long, toxic int"))
    assert fit(a) == fit(b)


# -- repeated bytes -------------------------------------------------------------------------------------------


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(1500):
        n, a = rng.randint(0, 40), rng.choice([1, 2, 3, 250])
        s = [rng.randrange(a) for _ in range(n)]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


def test_suffix_array_to_a_depth(monkeypatch):
    rng = random.Random(8)
    for n in (0, 1, 2, 3, 7, 31, 100, 400):
        for letters in (1, 2, 200):
            s = [rng.randrange(letters) for _ in range(n)]
            for depth in (1, 2, 3, 4, 9, 10, 50):
                got = suffix_array(np.array(s, np.int64), depth).tolist()
                assert sorted(got) == list(range(n)) and (k := [s[i : i + depth] for i in got]) == sorted(k)
    # windows need 50 bytes: names of 3, 9, 27 and 81, however long the repeats are
    sizes, whole = [], suffix_array

    def counted(s, *depth):
        sizes.append(len(s))
        return whole(s, *depth)

    monkeypatch.setattr("pagewright.llm.suffix_array.suffix_array", counted)
    monkeypatch.setattr(suffix_dedup, "suffix_array", counted)
    row = np.frombuffer(bytes(rng.randrange(256) for _ in range(30)) * 100, np.uint8)
    found = suffix_dedup.least_docs(np.concatenate([row, row]), np.array([0, 3000]), np.array([3000, 3000]), np.array([7, 5]))
    assert len(sizes) == 4 and sizes[0] == 6000
    assert set(found[:2951]) == set(found[3000:5951]) == {5} and not found[2951:3000].any() and not found[5951:].any()


def plain_removal(data):
    """data: (doc, bytes) in the order of docs."""
    seen, out = set(), {}
    for d in sorted(data):
        b = data[d]
        windows = [b[i : i + 50] for i in range(len(b) - 49)]
        mark = bytearray(len(b))
        for i, w in enumerate(windows):
            if w in seen:
                mark[i : i + 50] = b"\1" * 50
        seen.update(windows)
        out[d] = (len(b), sum(mark), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1])), hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("bounds", [{}, {"GROUP_BYTES": 200, "MANY": 2, "BLOCK_BYTES": 3000, "RANGE_VALUES": 50}])
def test_repeats(docs, corpus, none, bounds, monkeypatch):
    want = plain_removal({-1 if r[0] is None else r[0]: (r[1] or "").encode() for r in corpus if r[0] is not None or r[1]})
    for name, value in bounds.items():  # the small ones split anchors, groups, blocks and ranges
        monkeypatch.setattr(suffix_dedup, name, value)
    got = rows(suffix_dedup.remove_repeats(docs))
    assert len(got) == len(corpus)
    for r in got:
        d = -1 if r["doc_id"] is None else r["doc_id"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[d], d
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_of_one_letter(spark):
    data = {0: b"a" * 60, 1: b"a" * 49, 2: b"b" * 20 + b"a" * 300 + b"c", 3: b"ab" * 100, 4: b"ba" * 100}
    got = rows(suffix_dedup.remove_repeats(spark.createDataFrame([(k, v.decode()) for k, v in data.items()], "doc_id long, text string")))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == plain_removal(data)


# -- mixing ---------------------------------------------------------------------------------------------------


def test_targets():
    sizes, weights = [1000, 1000, 50, 0], [5.0, 2.0, 1.0, 5.0]
    t = mixing.fill_targets(sizes, weights, 1.5, 2.0)
    assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(x <= 2 * s for x, s in zip(t, sizes, strict=True))
    assert t[2] == 100 and t[3] == 0 and abs(t[0] - 2000) < 1e-9 and abs(t[1] - 975) < 1e-9


def test_split_tree():
    rng = np.random.default_rng(1)
    q = mixing.split_tree([100, 3, 0, 57], 7, rng)
    assert q.shape == (7, 4) and q.sum(axis=0).tolist() == [100, 3, 0, 57] and np.ptp(q.sum(axis=1)) <= 2


def test_mix(docs, corpus, none):
    options = {"block_words": 300, "shards": 4}
    got = rows(mixing.mix(docs, **options))
    again = rows(mixing.mix(docs.repartition(3), **options))
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(corpus)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus}
    source_of = lambda r: (r[3] is None, r[3] or "")
    totals = Counter()
    for r in corpus:
        totals[source_of(r)] += size[r[0]]
    order = sorted(totals)
    targets = dict(zip(order, mixing.fill_targets([totals[s] for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))], 1.5, 2.0), strict=True))
    plans = {p.src: p for p in mixing.plan_mix([("n" if s[0] else "s" + s[1], totals[s]) for s in order], mixing.WEIGHTS, 1.5, 2.0, 4, 300, 17)}
    taken, largest = Counter(), Counter()
    of_unit = defaultdict(set)
    for r in got:
        s = (r["source"] is None, r["source"] or "")
        assert r["size"] == size[r["doc_id"]] and len(r["draws"]) <= 2 and r["source_size"] == totals[s] and r["target"] == targets[s]
        assert [d["epoch"] for d in r["draws"]] == list(range(len(r["draws"])))
        taken[s] += r["size"] * len(r["draws"])
        largest[s] = max(largest[s], r["size"])
        for d in r["draws"]:
            of_unit[s, d["epoch"], d["block"]].add(d["shard"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    # a unit goes to one shard, and no shard gets more units of a source than its quota
    assert all(len(x) == 1 for x in of_unit.values())
    units = Counter((s, *x) for (s, _, _), x in of_unit.items())
    for s in order:
        p = plans["n" if s[0] else "s" + s[1]]
        quotas = np.diff(p.upto, prepend=0)
        assert all(units[s, k] <= q for k, q in enumerate(quotas))
        assert all(e * p.n_blocks + b < p.upto[-1] for (t, e, b) in of_unit if t == s)
    drawn = mixing.mixed_documents(docs, **options)
    assert drawn.columns == docs.columns
    assert Counter(r["doc_id"] for r in drawn.select("doc_id").collect()) == Counter(r["doc_id"] for r in got for _ in r["draws"])
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs, most_sources=3)


def test_mix_follows_the_tree(docs, monkeypatch):
    """Shards' quotas decide what is drawn: a tree that gives less draws less."""
    options = {"block_words": 300, "shards": 4}
    tree = mixing.split_tree
    full = sum(len(r["draws"]) for r in rows(mixing.mix(docs, **options)))
    monkeypatch.setattr(mixing, "split_tree", lambda q, shards, rng: tree(q, shards, rng) // (2 if shards == 4 else 1))
    assert 0.3 * full < sum(len(r["draws"]) for r in rows(mixing.mix(docs, **options))) < 0.7 * full


def test_quotas_are_a_plain_multivariate_draw():
    """Means and spreads of the first shard's quotas against units dealt at random."""
    q = [40, 10, 30]
    rng = np.random.default_rng(2)
    tree = np.array([mixing.split_tree(q, 4, rng)[0] for _ in range(4000)])
    cards = np.repeat([0, 1, 2], q)
    plain = np.array([np.bincount(rng.permutation(cards)[:20], minlength=3) for _ in range(4000)])
    assert np.abs(tree.mean(axis=0) - plain.mean(axis=0)).max() < 0.2 and np.abs(tree.std(axis=0) - plain.std(axis=0)).max() < 0.15


# -- packing --------------------------------------------------------------------------------------------------


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(bins) if room >= n]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_best_fit_plan_equals_one_piece_at_a_time():
    rng = random.Random(6)
    for _ in range(300):
        cap = rng.choice([5, 17, 64])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        plan, n = packing.plan_best_fit(Counter(lengths), cap)
        fill, ranks = defaultdict(list), Counter()
        for length, k0, k1, base, q, place in plan:
            for k in range(k0, k1):
                ranks[length, k] += 1
                fill[base + (k - k0) // q].append((place + length * ((k - k0) % q), length))
        assert set(ranks.values()) <= {1} and Counter(x[0] for x in ranks) == Counter(lengths)
        for b in fill.values():
            at = 0
            for place, length in sorted(b):
                assert place == at
                at += length
            assert at <= cap
        assert len(fill) == n and sorted(cap - sum(x for _, x in b) for b in fill.values()) == plain_best_fit(lengths, cap)


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_packing(docs, corpus, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_file())
    got = rows(packing.pack_documents(docs, with_ids=True))
    place, ids = defaultdict(list), defaultdict(dict)
    for r in got:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
        ids[r["doc_id"]][r["piece"]] = r["ids"]
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for p in place.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 1024
    for d, t, *_ in corpus:
        want = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(ids[d][k] for k in sorted(ids[d])), "<u4").tolist() == want
    assert packing.pack_documents(none).count() == 0


def library_ids(text, path=None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or packing.tokenizer_file()).encode(text, add_special_tokens=False).ids


def test_added_tokens_of_the_file(spark, tmp_path):
    import json

    e = "<|endoftext|>"
    texts = [e, f"{e}start", f"end{e}", f"a {e} b", f"x{e}{e}y", f"a \n {e}\n\n {e} ", "<|endoftext|", f"<|{e}|>", f"é {e} 日本", "plain"]
    enc = packing.ByteLevelIds(packing.tokenizer_file())
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library_ids(t), t
    got = {r["doc_id"]: r["ids"] for r in rows(packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True))}
    for k, t in enumerate(texts):
        assert np.frombuffer(got[k], "<u4").tolist() == [*library_ids(t), 2]
    # flags widen what a token takes, and a longer token wins where two start
    file = json.loads(Path(packing.tokenizer_file()).read_text(encoding="utf-8"))
    token = file["added_tokens"][0]
    for flags in ({}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}):
        file["added_tokens"] = [token | flags, token | {"id": 50257, "content": "<|endoftext|>>"}]
        path = tmp_path / f"{'-'.join(flags) or 'none'}.json"
        path.write_text(json.dumps(file), encoding="utf-8")
        other = packing.ByteLevelIds(str(path))
        for t in [*texts, f"a{e}>b {e}> {e}"]:
            assert np.frombuffer(other.encode(t), "<u4").tolist() == library_ids(t, str(path)), (flags, t)


def test_long_runs_of_white_space():
    enc = packing.ByteLevelIds(packing.tokenizer_file())
    for t in ("a" + " " * 1_200_000 + "b", "a" + "\n" * 1_100_000, "x <|endoftext|>" + "\t " * 600_000 + "<|endoftext|> y"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library_ids(t)
