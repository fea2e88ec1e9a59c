from folioweave.operators.sections import parse_text
from folioweave.sources.markdown import first_inline, links, scan_lines

PAYLOAD = "```yaml\nsection: {}\n```\n"


def kinds(text):
    return [(b.kind, b.start, b.end) for b in scan_lines(text.split("\n")).blocks]


def test_blocks():
    assert kinds("# A #\n\ntext\nmore\n\n    code\n\n---\n") == [("heading", 0, 1), ("paragraph", 2, 4), ("code", 5, 6), ("rule", 7, 8)]
    assert kinds("Title\n=====\nx\n") == [("heading", 0, 2), ("paragraph", 2, 3)]
    assert kinds("~~~ yaml\n# no heading\n~~~~\n> # quoted\n> text")[0] == ("fence", 0, 3)
    assert [k[0] for k in kinds("> # quoted\n> text\n\n- item\n  more\n- next")] == ["quote", "heading", "paragraph", "list", "paragraph", "list", "paragraph"]
    assert kinds("````\n```\n````\n") == [("fence", 0, 3)]
    assert kinds("<!-- a\n\nb -->\ntext") == [("html", 0, 3), ("paragraph", 3, 4)]
    assert kinds("") == []


def test_links():
    assert links("a [@ref: b](c.md#d) `[x](y)` \\[z](w) ![i](j) [k][L] <", {"l": "m"}) == [("@ref: b", "c.md#d"), ("k", "m")]
    assert links("[a [b](c) d](e)", {}) == [("b", "c")]
    assert links("[t](<sp ace.md#x> 'title')", {}) == [("t", "sp ace.md#x")]


def test_heading_text_is_its_first_inline():
    assert [first_inline(x) for x in ("plain text", "plain *em*", "*em* x", "`code` x")] == ["plain text", "plain ", "", "code"]


def test_sections_extents_and_directives():
    text = "# Top\n\n" + PAYLOAD.format("top") + "\n[@ref: x](#low) and [@include](../o/b.md#i)\n\n## Low\n\n" + PAYLOAD.format("low") + "[@query: q](a=b)\n\n# Next\n\n" + PAYLOAD.format("next") + "end\n\n\n"
    sections, problems = parse_text("/r/s/a.md", text)
    assert not problems
    assert [(s["id"], s["start_line"], s["end_line"]) for s in sections] == [("top", 1, 15), ("low", 9, 15), ("next", 16, 21)]
    assert [(d["type"], d["target_uri"], d["label"]) for d in sections[0]["directives"]] == [("ref", "/r/s/a.md#low", "x"), ("include", "/r/o/b.md#i", None)]
    assert sections[1]["directives"][0]["type"] == "query"
    assert sections[2]["content"].endswith("end\n")


def test_payload_rules():
    kind = lambda text: [p["type"] for p in parse_text("/a.md", text)[1]]
    assert kind("# A\n\ntext\n\n" + PAYLOAD.format("a")) == ["payload_not_first"]
    assert kind("# A\n\n```yaml\nx: 1\n```\n" + PAYLOAD.format("a")) == ["payload_not_first"]
    assert kind("# A\n\n    code\n\n```py\n1\n```\n" + PAYLOAD.format("a")) == []
    assert kind("# A\n" + PAYLOAD.format("a") + PAYLOAD.format("a")) == ["duplicate_payload"]
    assert kind("# A\n" + PAYLOAD.format("")) == ["missing_payload"]
    assert kind("# A\n" + PAYLOAD.format("a") + "# B\n" + PAYLOAD.format("a")) == ["duplicate_id"]
    assert parse_text("/a.md", "# A\n" + PAYLOAD.format("a") + "# B\n" + PAYLOAD.format("a"), permissive=False)[0] == []
    assert parse_text("/a.md", "# only a heading\ntext") == ([], [])


def test_user_id_is_overwritten_and_values_keep_python_text():
    (s,), _ = parse_text("/a.md", "# A\n```yaml\nid: x\nsection: y\nflag: yes\nday: 2024-01-02\nlist: [a, b]\nnone:\n```\n")
    assert s["id"] == "y" and s["meta_str"] == {"id": "y", "flag": "True", "day": "2024-01-02", "list": "['a', 'b']", "none": "None"}
    assert s["meta_json"] == '{"id": "y", "flag": true, "day": "2024-01-02", "list": ["a", "b"], "none": null}' or '"day": "2024-01-02"' in s["meta_json"]
