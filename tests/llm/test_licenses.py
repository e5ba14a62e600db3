import re

import pytest

from lodestone.llm.licenses import BASE, license_scan
from rows import clashing, frame, prose

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def scanned(spark, texts):
    rows = license_scan(clashing(frame(spark, texts))).orderBy("doc_id").collect()
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows]


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize(
    "text",
    [
        None, "", " ;; ", "mit", "MIT License", "mit\nlicense, cc-by 4.0 the Apache/License", "GNU General Public", "x GNU General Public License",
        "gnu general public license gnu general public license cc by cc by", "ÉMIT license mit licenseÉ", "a mit license\x00cc by", "Kcc by İ MIT LICENSE",
    ],
)
def test_base_phrases(spark, text):
    got = scanned(spark, [text])[0]
    assert got[:5] == brute_base(text)
    assert set(filter(None, got[4].split(","))) <= set(got[5].split(","))


def test_votes_find_notices_and_edited_notices(spark):
    padding = prose(50, 1)
    edited = MIT.replace("obtaining a copy", "obtaining one more copy").lower()
    rows = scanned(spark, [f"{padding} {MIT} {padding}", f"{padding} {edited}", " ".join(MIT.split()[:8]), " ".join(reversed(MIT.split())), f"{MIT} x {MIT}"])
    assert [r[5] for r in rows] == ["mit", "mit", "", "", "mit"]
    assert rows[0][6] == 1.0 and 0.8 <= rows[1][6] < 1.0 and rows[2][6] == 0.0


CC = "This work is licensed under a Creative Commons Attribution%s International License."
GNU = "You may redistribute it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation."


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (GNU % "", "gpl"), (GNU % "Lesser ", "lgpl"), (GNU % "Affero ", "agpl"), (GNU % "Library ", "lgpl"),
        (CC % " 4.0", "cc-by"), (CC % "-ShareAlike 4.0", "cc-by-sa"), (CC % "-NonCommercial 4.0", "cc-by-nc"),
        (CC % "-NoDerivatives 4.0", "cc-by-nd"), (CC % "-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"),
        (CC % "-NonCommercial-NoDerivatives 4.0", "cc-by-nc-nd"),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        # Letters beyond A-Z stay as they are: the Kelvin sign is no k.
        ((CC % " 4.0").replace("work", "wor\u212a"), "cc-by"),
        (GNU % "" + " " + GNU % "Affero ", "agpl,gpl"),
    ],
)
def test_neighbouring_licences_are_told_apart(spark, text, labels):
    assert scanned(spark, [f"{prose(30, 2)} {text} {prose(30, 3)}"])[0][5] == labels


def test_only_a_to_z_are_lowered(spark):
    """A notice with a Kelvin sign for its k scores by the words that are left."""
    whole, changed = (scanned(spark, [t])[0] for t in (CC % " 4.0", (CC % " 4.0").replace("work", "wor\u212a")))
    assert whole[6] == 1.0 and changed[6] < 1.0


def test_far_diagonals_are_not_merged(spark):
    words = MIT.split()
    spread = " ".join(" ".join(words[i : i + 4]) + " " + prose(20, i) for i in range(0, len(words), 4))
    assert scanned(spark, [spread])[0][5] == ""


def test_repeated_rows_and_missing_ids(spark):
    rows = license_scan(frame(spark, ["MIT License", "MIT License", "cc by", None], ids=[1, 1, None, None])).collect()
    assert sorted((str(r.doc_id), r.n_base, r.labels) for r in rows) == [("1", 1, "mit"), ("1", 1, "mit"), ("None", 0, ""), ("None", 1, "cc-by")]


def test_empty_table(spark):
    assert scanned(spark, []) == []
