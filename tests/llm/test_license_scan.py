import math
import re
from collections import Counter

from slopefield.llm import license_scan as S

FILES = "id long, path string, text string, licence_file boolean, word string, folder string"
MIT, GPL = S.TEMPLATES["MIT"], S.TEMPLATES["GPL-3.0"]


def scanned(table_of, rows):
    df = table_of([(*r, "w", "f") for r in rows], FILES, "files")
    return {r.id: r for r in S.scan(df).collect()}


def test_own_and_inherited(table_of):
    found = scanned(
        table_of,
        [
            (1, "a/LICENSE", MIT, True),
            (2, "a/x.txt", "words\n  " + GPL.upper() + "  \nmore", False),
            (3, "a/y.txt", "no notice", False),
            (4, "a/b/c/z.txt", "", False),
            (5, "a/b/LICENSE", "text\n" + GPL, True),
            (6, "ab/z.txt", None, False),
            (7, "top.txt", "a license is mentioned here in passing by someone", False),
            (8, None, "x", False),
            (9, None, MIT, True),
            (10, "a/b/LICENSE-2", MIT, True),
            (11, "q/LICENSE", "nothing of that kind", True),
            (12, "q/n.txt", "n", None),
            (13, "a/long.txt", "word " * 50_000 + "\n" + MIT, False),
        ],
    )
    get = lambda k: (found[k].licence, found[k].origin, found[k].directory)
    assert get(1) == ("MIT", "own", None) and get(2) == ("GPL-3.0", "own", None)
    assert get(3) == ("MIT", "inherited", "a")
    assert get(4) == ("GPL-3.0", "inherited", "a/b")  # of two as near, the first by name
    assert get(6) == get(7) == get(8) == get(11) == get(12) == (None, "none", None)
    assert get(9) == ("MIT", "own", None) and get(13) == ("MIT", "own", None)
    assert found[1].cosine > 0.99 and found[7].cosine is None


def test_no_python_in_the_plan(table_of, capsys):
    df = table_of([(1, "a/LICENSE", MIT, True, "w", "f")], FILES, "files")
    S.scan(df).explain("extended")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_repeated_rows_and_empty_tables(table_of):
    found = scanned(table_of, [(k, "d/LICENSE", MIT, True) for k in range(40)] + [(99, "d/f", "", False)])
    assert all(r.licence == "MIT" for r in found.values()) and len(found) == 41
    assert scanned(table_of, []) == {}
    assert {r.origin for r in scanned(table_of, [(1, "a", "b", False)]).values()} == {"none"}


def licence_text(name):
    return next(t for k, t in S.all_templates() if k == name and len(t.split()) > 150)


def commented(text, sign, width=70):
    import textwrap

    return "\n".join(f"{sign} {x}".rstrip() for p in text.split("\n\n") for x in [*textwrap.wrap(p, width), ""])


def test_real_headers_and_licence_files(table_of):
    gpl3, gpl2 = S.HEADERS["GPL-3.0"][1], S.HEADERS["GPL-2.0"][1]
    apache = S.HEADERS["Apache-2.0"][0].replace(" Unless", "\n\nUnless")
    code = "\ndef run(values):\n    return sorted(values)\n\nclass Name:\n    pass\n"
    rows = [
        (1, "a/x.py", "# Copyright 2020 Some One\n#\n" + commented(gpl3, "#") + code * 9, False),
        (2, "a/y.py", commented(gpl2, "#") + code, False),
        (3, "a/z.c", "/*\n" + commented(apache, " *") + " */\nint main(void) { return 0; }\n" + code, False),
        (4, "b/w.py", "# SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)\n" + code, False),
        (5, "b/v.py", "# SPDX-License-Identifier: ISC\n" + code, False),
        (6, "c/m.txt", code + "\n" + licence_text("MIT").replace("<year> <copyright holders>", "2021 A"), False),
        (7, "c/r.py", commented(gpl3.split(" This program is distributed")[0], "#", 60).strip() + code, False),
        (8, "c/de.txt", "Copyright mit allen\nin the mozilla of a public source", False),
    ]
    names = ["Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "MPL-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause"]
    rows += [
        (20 + k, f"f{k}/LICENSE", "Some Project\n\n" + licence_text(n).replace("<year>", "1999"), True)
        for k, n in enumerate(names)
    ]
    found = {k: r.own_licence for k, r in scanned(table_of, rows).items()}
    assert [found[20 + k] for k in range(len(names))] == names
    assert [found[k] for k in (1, 2, 3, 6, 7)] == ["GPL-3.0", "GPL-2.0", "Apache-2.0", "MIT", "GPL-3.0"]
    assert found[4] in ("MIT", "GPL-2.0") and found[5] is None and found[8] is None


def plain_words(text):
    return set(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()))


def best_by_brute_force(found, templates):
    """(licence, cosine) by passage: full TF-IDF vectors of every passage and template."""
    texts, copies = {}, Counter()
    for r in found:
        texts[r.key] = r.passage
        copies[r.key] += r.core
    total, df = sum(copies.values()), Counter()
    for key, text in texts.items():
        for w in plain_words(text):
            df[w] += copies[key]
    weight = lambda w: math.log((1 + total) / (1 + df[w])) + 1
    out = {}
    for key, text in texts.items():
        mine = {w: weight(w) for w in plain_words(text)}
        best = None
        for licence, notice in templates:
            other = {w: weight(w) for w in plain_words(notice)}
            dot = sum(mine[w] * other[w] for w in mine.keys() & other.keys())
            norms = math.sqrt(sum(v * v for v in mine.values()) * sum(v * v for v in other.values()))
            cosine = round(dot / norms, 6) if norms else 0.0
            if cosine >= S.THRESHOLD:
                best = min(best or (0, "~"), (-cosine, licence))
        if best:
            out[key] = (best[1], -best[0])
    return out


def test_cosines_of_all_passages_against_brute_force(table_of):
    """Blocks, headers, identifiers and whole licence files, not single lines only."""
    gpl = S.HEADERS["GPL-3.0"][1]
    rows = [
        (1, "a/x.py", commented(gpl, "#") + "\n\nx = 1\n", False),
        (2, "a/LICENSE", "Project\n\n" + licence_text("MIT"), True),
        (3, "b/LICENSE", "Project\n\n" + licence_text("Apache-2.0")[:3000], True),
        (4, "c/y.txt", f"first\n{MIT}\nsecond line\n\n{GPL} and so on\nwith more text here", False),
        (5, "c/z.py", "# SPDX-License-Identifier: (Apache-2.0 AND MIT)\n\npass\n", False),
        (6, "c/w.txt", "this license text is like no other at all\n" * 3, False),
    ]
    df = table_of([(*r, "w", "f") for r in rows], FILES, "files")
    found = S.passages(df.select("id", "path", "text", "licence_file")).collect()
    templates = S.all_templates()
    want = best_by_brute_force(found, templates)
    mine = S._best_templates(S.passages(df.select("id", "path", "text", "licence_file")), templates)
    got = {r.key: (r.licence, r.cosine) for r in mine.collect()}
    assert got.keys() == want.keys() and len(got) >= 8
    for key, (licence, cosine) in want.items():
        assert got[key][0] == licence and abs(got[key][1] - cosine) < 2e-6
    assert {len(r.passage.split()) > 100 for r in found if r.key in want} == {True, False}
