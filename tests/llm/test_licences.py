import textwrap

from visitlens.llm import queries
from visitlens.llm.licence_texts import LICENCES
from visitlens.llm.licences import scan

MIT = "MIT License\n\n" + dict(LICENCES[:1])["MIT"]


def test_whole_table(same_as_oracle):
    same_as_oracle(queries.op9_licences, queries.ORACLE_SQL["op9_licences"])


def test_forms(make_docs, clashes):
    body = MIT.split("\n\n", 2)[2]
    texts = [
        MIT,
        MIT.upper().replace("\n\n", "\n"),
        "MIT Licence\n\n(c) 2019 Some One\nCopyright © 2020-2024 Others, Inc.\nAll rights reserved.\n\n" + body.replace("\"", "”").replace(" ", "  "),
        "# Copyright (C) 2001 X\n" + body.replace("holders", "owners").replace("HOLDERS", "OWNERS"),
        MIT + " and more",
        body[:-60],
        None,
        "",
        "...",
        "LICENCED under the Apache Licence,\nversion 2.0",
        "x " * 100_000,
    ]
    out = scan(make_docs(texts, **clashes))
    assert len(out.columns) == len(set(out.columns))
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i]["_licence"] for i in range(len(texts))] == ["MIT"] * 4 + [None] * 5 + ["notice:Apache-2.0", None]
    assert [rows[i]["_contained"] for i in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10)] == [["MIT"], ["MIT"], ["MIT"], ["MIT"], [], [], [], [], ["notice:Apache-2.0"], []]
    assert rows[4]["_digest"] and rows[5]["_digest"] and rows[8]["_digest"] is None
    assert rows[6]["_n_words"] is None and rows[7]["_n_words"] == 0 and rows[10]["_n_words"] == 100_000
    assert scan(make_docs([])).count() == 0


def test_every_known_text(make_docs):
    rows = {r.doc_id: r for r in scan(make_docs([t for _, t in LICENCES])).collect()}
    assert {i: r["_licence"] for i, r in rows.items()} == {i: n for i, (n, _) in enumerate(LICENCES)}
    for i, (name, _) in enumerate(LICENCES):
        assert rows[i]["_contained"] == [name]


def test_blocks_and_lines(make_docs):
    """Licences within other text: wrapped otherwise, with notices, and two of them."""
    texts = dict(LICENCES)
    wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 50, initial_indent=" * ", subsequent_indent=" * ")) for p in texts["ISC"].split("\n\n"))
    docs = [
        "Some code.\n\n" + wrapped + "\n\nMore of it.\nReleased under the MIT License.",
        texts["Apache-2.0"] + "\n\n----\n\n" + texts["MPL-2.0"],
        "prose\nSPDX-Licence-Identifier: GPL-3.0\nprose",
        "prose Released under the MIT License. prose",
        texts["GPL-3.0"].replace("General Public", "Special Public"),
    ]
    got = {r.doc_id: r["_contained"] for r in scan(make_docs(docs)).collect()}
    assert got == {0: ["ISC", "notice:MIT"], 1: ["Apache-2.0", "MPL-2.0"], 2: ["notice:GPL-3.0"], 3: [], 4: []}


def test_spellings(make_docs):
    """Equivalent words side by side are all replaced; other words are left alone."""
    rows = scan(make_docs(["licence licence LICENCES relicence", "license License licenses relicence", "licence license licenses relicense"])).collect()
    digests = {r.doc_id: r["_digest"] for r in rows}
    assert digests[0] == digests[1] != digests[2]
