import xml.parsers.expat as expat

import pytest

from lectern.sources import milestones as M


def segments(body, **said):
    events = M.Events()
    for line in f"<TEI><teiHeader><title> A  title</title><author/></teiHeader><text lang='la'><body>{body}</body></text></TEI>".splitlines(keepends=True):
        events.feed(line)
    events.feed("", True)
    assert events.said["title"] == "A title" and events.said["author"] is None and events.said["language"] == "la"
    return [(c, t) for c, _, t, _ in events.segments]


def test_milestones_cut_across_elements():
    assert segments("""<div1 type="book" n="1"><p>before <milestone unit="chapter" n="pr"/> <milestone unit="section" n="1"/>one
      <hi>two <note>three</note></hi> <milestone unit="section" n="2"/>four</p><p>on <milestone unit="section" n="3"/>five</p></div1>
      <div1 type="book" n="2"><p>new <milestone unit="chapter" n="1"/>six</p></div1><p>out</p>""") == [
        ("1", "before"), ("1.pr.1", "one two three"), ("1.pr.2", "four"), ("1.pr.2", "on"), ("1.pr.3", "five"), ("2", "new"), ("2.1", "six"), ("8", "out"),
    ]


def test_higher_milestones_end_deeper_ones():
    assert segments("""<p><milestone unit="book" n="1"/><milestone unit="chapter" n="2"/><milestone unit="section" n="3"/>a<milestone unit="chapter" n="3"/>b
      <milestone unit="book" n="2"/>c<milestone unit="section" n="9"/>d<milestone unit="card" n="7"/>e<milestone unit="section"/>f</p>""") == [
        ("1.2.3", "a"), ("1.3", "b"), ("2", "c"), ("2.9", "d"), ("2.9.7", "e"), ("2.9.7", "f"),
    ]


def test_lines_pages_and_columns():
    events = M.Events()
    events.feed("""<TEI><text><body><div n="urn:cts:x:y" type="edition"><pb n="1"/><p>a <lb n="5"/>b<cb n="2"/> c <lb/>d wo<lb break="no"/>rd <pb n="2"/>
      <lb n="6"/>e</p><lg><l n="1">verse &amp; &eacute; & more</l><l>unnumbered</l></lg></div></body></text></TEI>""", True)
    assert events.segments == [
        ("1", "paragraph", "a", "1"), ("5", "line", "b c d word", "1"), ("6", "line", "e", "2"), ("1", "line", "verse & é & more", "2"), ("6", "line", "unnumbered", "2"),
    ]
    assert events.said["urn"] == "urn:cts:x:y"


def test_little_is_held():
    events = M.Events()
    events.feed("<TEI><text><body><p>")
    for k in range(40_000):
        events.feed(f'<milestone unit="section" n="{k}"/>some <hi>words</hi> of it\n' + ("</p><p>" if k % 5 == 0 else ""))
        if len(events.segments) > 100:
            events.segments.clear()
    assert events.count == 39_999 and len(events._open) == 4 and len(events._text) < 5
    with pytest.raises(expat.ExpatError):
        events.feed("</nothing>")


def test_files_in_pieces(spark, tmp_path):
    """A file that Spark splits gives what it gives whole; broken and empty files give what they have."""
    body = "\n".join(f'<p><milestone unit="section" n="{k}"/>text number {k}</p>' for k in range(3000))
    (tmp_path / "a.xml").write_text(f'<TEI><text><body><div n="1">\n{body}\n</div></body></text></TEI>')
    (tmp_path / "b.xml").write_text('<TEI><text><body><p>one</p>\n<p>two<x></p>\n<p>three</p></body></text></TEI>')
    (tmp_path / "c.xml").write_text("")
    (tmp_path / "d.xml").write_text("<TEI><text><body><p>cut off</p>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = M.file_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        rows = M.read_milestones(lines).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    of = lambda name: [r for r in rows if r["path"].endswith(name)]
    assert [(r["place"], r["citation"], r["text"]) for r in of("a.xml")] == [(k + 1, f"1.{k}", f"text number {k}") for k in range(3000)]
    assert [r["text"] for r in of("b.xml")] == ["one", None] and of("b.xml")[1]["error"].startswith("ExpatError: mismatched tag")
    assert of("c.xml") == [] and [r["text"] for r in of("d.xml")] == ["cut off", None]
