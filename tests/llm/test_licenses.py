import textwrap

from quillmark.llm.licenses import TEMPLATES, licenses

CASES = [
    ("Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore prose.", ["Apache-2.0"]),
    ("text RELEASED UNDER THE MIT LICENSE. more text follows after it and it goes on for a while so that the block is long enough to be cut", ["MIT"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
    ("Licensed under CC BY 4.0.\nReleased under the MIT License.", ["CC-BY-4.0", "MIT"]),
    ("Licensed under the Apache License, Version 1.1.", []),
    ("The driving license was shown. Copyright is a right.", []),
    (None, []),
    ("", []),
    ("license " * 30_000, []),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(CASES)] + [(None, CASES[0][0], 1)], "doc_id long, text string, found int")
    got = {r.doc_id: r for r in licenses(docs).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i].licenses == want, (text, got[i])
        assert got[i].n_licenses == len(want)
    assert got[None].licenses == ["Apache-2.0"]
    hit = got[0].found[0]
    assert CASES[0][0][hit.start : hit.end] == "Licensed under the Apache License, Version 2.0"


def test_every_template_names_itself(spark):
    rows = [(f"{name}/{i}", f"before\n{text}\nafter") for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses(docs).collect()}
    for i, (name, _) in enumerate(rows):
        assert got[i] == [name.split("/")[0]], (name, got[i])


def test_empty_table(spark):
    assert licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_wrapped_notices(spark):
    rows = [(name, before + textwrap.fill(text, width, initial_indent=lead, subsequent_indent=lead, break_on_hyphens=False) + "\nother words\n") for name, texts in TEMPLATES.items() for text in texts for width, lead, before in ((78, "", "Some prose.\n\n"), (60, " * ", "/*\n"), (40, "# ", ""))]
    rows.append(("GPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"))
    rows.append(("GPL-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n"))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses(docs).collect()}
    for i, (name, text) in enumerate(rows):
        assert got[i] == [name], (text, got[i])


def test_ranking_and_confirmation_by_brute_force():
    """A confirmed template has most of its words in order, and none of those
    that save more bytes is confirmed."""
    import difflib

    from quillmark.llm import licenses as module

    matcher = module._Matcher()
    for block in [" ".join(t.split()) for texts in TEMPLATES.values() for t in texts] + ["Licensed under the Apache License, Version 2.1.", "the public domain is free", "copyright 1999 by me"]:
        data = block.lower().encode()
        saved = [(len(matcher.plain.compress(data)) - len(c.compress(data)), i) for i, (_, _, c) in enumerate(matcher.templates)]
        words, want = module._words(block), None
        for gain, i in sorted(saved, key=lambda x: (-x[0], x[1])):
            name, wanted, _ = matcher.templates[i]
            parts = [m for m in difflib.SequenceMatcher(None, words, wanted, autojunk=False).get_matching_blocks() if m.size]
            if gain > 0 and parts and sum(m.size for m in parts) >= module.LEAST_SHARE * len(wanted) and matcher._confirmed(words, wanted):
                want = name
                break
        pieces = [name for _, _, name, _ in matcher.match(block)]
        assert want is None or want in pieces, (block, want, pieces)
