from daymark.sources.rescue import read_rescued

SCHEMA = "id long, name string, at date"


def test_headers_and_broken_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffname,at,id,more\n"x, ""y""",2024-01-02,1,z\n,,2,\n\nname only\n"open,2024-01-02,3,z\n', "utf-8")
    (tmp_path / "b.csv").write_text("id,name\n4,b\nid,name\nfive,c\n6,d,e\n7,\n", "utf-8")
    (tmp_path / "c.csv").write_text("", "utf-8")
    found = read_rescued(spark, str(tmp_path), SCHEMA)
    assert found.rows.columns == ["id", "name", "at"]
    got = sorted((r["id"], r["name"], str(r["at"])) for r in found.rows.collect())
    assert got == [(1, 'x, "y"', "2024-01-02"), (2, None, "None"), (4, "b", "None"), (7, None, "None")]
    bad = sorted((r["file"][-5:], r["line"], r["reason"]) for r in found.rejected.collect())
    assert bad == [
        ("a.csv", '"open,2024-01-02,3,z', "open quote"),
        ("a.csv", "name only", "1 fields, 4 in the header"),
        ("b.csv", "6,d,e", "3 fields, 2 in the header"),
        ("b.csv", "five,c", "id is no bigint"),
    ]
    headers = {r["file"][-5:]: (r["missing"], r["extra"], r["reordered"]) for r in found.headers.collect()}
    assert headers == {"a.csv": ([], ["more"], True), "b.csv": (["at"], [], False)}


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "c.csv").write_text("", "utf-8")
    found = read_rescued(spark, str(tmp_path), SCHEMA)
    assert found.rows.count() == found.rejected.count() == found.headers.count() == 0
