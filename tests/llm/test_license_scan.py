import math
import random

from gatewright.llm import license_scan

from .helpers import PLAIN, frame, lower, odd_rows, sentence


def brute_places(text):
    w = PLAIN.findall(lower(text))
    return sorted((label, a) for label, p in license_scan.PHRASES.items() for a in range(len(w)) if w[a : a + len(p)] == list(p))


def brute_hits(text, threshold=0.8, block=license_scan.BLOCK_WORDS):
    out, at = [], 0
    for line in (text or "").split("\n"):
        w = PLAIN.findall(lower(line))
        for h in range(0, max(len(w) - block // 2 - 1, 0) + 1, block // 2):
            own = set(w[h : h + block])
            for label, texts in license_scan.TEMPLATES.items():
                for t in texts:
                    tokens = set(license_scan.tokens_of(t))
                    share = len(tokens & own) / len(tokens)
                    if len(tokens & own) >= math.ceil(threshold * len(tokens) - 1e-9):
                        out.append((label, round(share, 9)))
        at += len(w)
    return sorted(out)


def rows_():
    rng = random.Random(12)
    rows = odd_rows()
    notices = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    for k in range(120):
        words = rng.choice(notices).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(["foo", "the", "License", ""])
        if k % 4 == 0:
            rng.shuffle(words)
        text = sentence(rng, rng.randrange(60)) + rng.choice(["\n", " ", "; "]) + (" ".join(words).upper() if k % 5 == 0 else ", ".join(words))
        if k % 6 == 0:
            text += "\n" + sentence(rng, 150) + " the MIT  License. Apache-License, VERSION 2; cc by nc cc by nc"
        rows.append((500 + k, text, "en", "s", 0))
    return [*rows, (700, "the mit\nlicense", "en", "s", 0), (701, "the mit licenseé", "en", "s", 0), (702, "the Kit license, the mıt license", "en", "s", 0)]


def test_join_and_phrases_match_brute_force(spark):
    rows = rows_()
    got = license_scan.scan_licenses(frame(spark, rows, extra=True)).collect()
    key = lambda x: repr(x)
    have = sorted(((r["doc_id"], r["n_words"], sorted((p["label"], p["at"]) for p in r["phrases"]), sorted((h["label"], round(h["containment"], 9)) for h in r["hits"])) for r in got), key=key)
    want = sorted(((r[0], len(PLAIN.findall(lower(r[1]))), brute_places(r[1]), brute_hits(r[1])) for r in rows), key=key)
    assert have == want
    assert sum(bool(w[3]) for w in want) > 40


def test_order_does_not_change_the_hits(spark):
    rows = rows_()
    df = frame(spark, rows)
    vocabulary = sorted({t for ts in license_scan.TEMPLATES.values() for x in ts for t in license_scan.tokens_of(x)})
    label = lambda d: sorted((r["doc_id"] or 0, sorted(h["label"] for h in r["hits"])) for r in d.collect())
    assert label(license_scan.scan_licenses(df)) == label(license_scan.scan_licenses(df, order=vocabulary))


def test_spans_lie_on_the_notice(spark):
    text = "w1 w2\nw3 released under the mit license now"
    hit = license_scan.scan_licenses(frame(spark, [(1, text, "en", "s", 0)])).first()["hits"][0]
    assert (hit["label"], hit["first_word"], hit["last_word"]) == ("mit", 3, 7)


def test_wrapped_notices_are_found(spark):
    rng = random.Random(13)
    texts = {
        "gpl-3": "This work is licensed under the GNU General\nPublic License version 3",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
        "mpl-2": "w1 w2\n\n" + sentence(rng, 200) + "\nThis Source Code Form is\nsubject to the terms of the\nMozilla Public License v. 2.0.\n" + sentence(rng, 90),
        "isc": sentence(rng, 31) + "\nPermission to use, copy, modify, and/or distribute\r\nthis software for any purpose with or\r\nwithout fee is hereby granted",
    }
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts.values())]
    rows.append((9, "Released under the MIT License\n" + sentence(rng, 300) + "\nReleased under\nthe MIT License", "en", "s", 0))
    rows.append((10, "den mit.\nLicensed under the Apache License, Version 2.0.", "de", "s", 0))
    hits = {r["doc_id"]: r["hits"] for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert [{h["label"] for h in hits[i]} for i in range(4)] == [{label} for label in texts]
    assert all(h["containment"] == 1.0 for i in range(4) for h in hits[i])
    assert hits[0][0]["first_word"] == 0 and hits[0][0]["last_word"] == 11
    assert {h["first_word"] for h in hits[9]} >= {0, 305}  # the one on a line, and the one over two
    assert {h["label"] for h in hits[10]} == {"apache-2"}  # its words make no other notice with those around


def test_whole_license_texts_are_templates(spark):
    rng = random.Random(19)
    body = " ".join(f"Clause{k} of w{k % 40} the" for k in range(60))  # 240 words
    words = body.split()
    wrapped = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    rows = [
        (1, sentence(rng, 500) + "\n" + wrapped + "\n" + sentence(rng, 300), "en", "s", 0),
        (2, sentence(rng, 90) + " " + body.upper(), "en", "s", 0),
        (3, sentence(rng, 900), "en", "s", 0),
        (4, wrapped[: len(wrapped) // 2], "en", "s", 0),
        (5, "Released under the MIT License", "en", "s", 0),
    ]
    templates = {"body": (body,), "mit": ("Released under the MIT License",)}
    got = {r["doc_id"]: {h["label"] for h in r["hits"]} for r in license_scan.scan_licenses(frame(spark, rows), templates=templates).collect()}
    assert got == {1: {"body"}, 2: {"body"}, 3: set(), 4: set(), 5: {"mit"}}


def test_the_sql_finds_wrapped_notices_too(spark, tmp_path):
    import duckdb

    from gatewright.llm import oracle, queries

    rng = random.Random(20)
    notices = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    rows = rows_()
    for k in range(60):
        words = rng.choice(notices).split()
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(1, len(words))
            words[i] = "\n" + words[i]
        rows.append((900 + k, sentence(rng, rng.randrange(80)) + "\n" + " ".join(words) + rng.choice(["", "\n" + rng.choice(notices)]) + "\n" + sentence(rng, rng.randrange(80)), "en", "s", 0))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({oracle.op2_sql()})").fetchall()
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    found = [r for r in want if r[0] and r[0] >= 900]
    assert sum(r[-1] > 0 for r in found) > 0.9 * len(found)


def test_base_columns_are_those_of_the_contract(spark, tmp_path):
    """The phrases are written out here: the operator's own are what is tested."""
    from gatewright.llm import queries

    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    texts = [
        "Released under the MIT License.",
        "the MIT license; den mit license",  # one word of the phrase is missing
        "under the\x00MIT\r\nLicense_UNDER-the[mit]license, CC by-nc",
        "under the mit licenseé, éunder the mit license, under the mıt license",
        "w " * 70000 + "Apache License, Version 2.0\n\n" + "w " * 70000 + "under the mit license",
        "cc by nc " * 300,
        ", ".join(["Under the MIT License", "cc by", "nc", "the mit license", "apache license version 2"]),
        "under the mit",
        None,
    ]
    frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in enumerate(texts):
        w = PLAIN.findall(lower(text))
        found = [(at, label) for label, p in phrases.items() for at in range(len(w)) if w[at : at + len(p.split())] == p.split()]
        places = [at for at, _ in found]
        want.append((i, len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))))
    got = queries.op2_license_scan(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == want
    assert [r[2] for r in want] == [1, 0, 3, 0, 2, 300, 3, 0, 0]


def test_empty_table(spark):
    assert license_scan.scan_licenses(frame(spark, [])).collect() == []
