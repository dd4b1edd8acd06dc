"""Parsers with look-ahead against a plain loop over the lines."""

import random
import re

from clausegraph.sources import looking_ahead as la

NUM = "一二三四五六七八九十百零"


def plain_law(lines):
    out, chapter, article, skip = [], None, None, False
    for i, line in enumerate(lines):
        if skip:
            skip = False
            continue
        head = re.match(rf"^(第[{NUM}]+章)\s*(.*)$", line)
        if head:
            article = None
            title = head.group(2).strip()
            if not title and i + 1 < len(lines):
                title, skip = lines[i + 1], True
            chapter = f"{head.group(1)} {title}"
            continue
        found = re.match(rf"^(第[{NUM}]+条)\s*(.*)$", line)
        if found:
            article = [chapter or "正文", found.group(1), found.group(2)]
            out.append(article)
        elif article:
            article[2] += line
    return [(c, n, re.sub(r"\s+", " ", t).strip()) for c, n, t in out]


def test_web_law(spark):
    rng = random.Random(1)
    pieces = ["第一章", "第二章 总则", "第三章", "第一条 甲：", "第二条", "第十条乙", "（一）丙", "丁 戊", "第章", "x"]
    docs = [[rng.choice(pieces) for _ in range(rng.randint(0, 14))] for _ in range(300)] + [[], None]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, lines array<string>")
    got = {}
    for r in la.parse_web_law(rows, "id").orderBy("id", "article_no").collect():
        got.setdefault(r["id"], []).append((r["chapter"], r["num"], r["body"]))
    assert got == {i: plain_law(d) for i, d in enumerate(docs) if d and plain_law(d)}


def plain_sections(lines, least=20):
    out, chapter, now = [], None, ""
    for line in lines:
        head = re.match(r"^(\d+)\s+([^\d].{0,40})$", line)
        if head:
            chapter, now = f"{head.group(1)} {head.group(2)}", head.group(1)
            continue
        found = re.match(r"^(\d+(?:\.\d+)+)\s+(.*)$", line)
        if not found:
            continue
        num, body = found.group(1), found.group(2).strip()
        top = num.split(".")[0]
        if len(body) < least or int(top) > 20 or re.match(r"下列文件|下列术语", body) or re.match(r"^(GB|GB/T|XF|XF/T|DB)\b", body) or now == "2":
            continue
        if chapter is None or top != now:
            chapter, now = f"{top} 条款", top
        out.append((chapter, num, body))
    return out


def test_sections_with_chapters(spark):
    rng = random.Random(2)
    long = "内容" * 12
    pieces = ["1 范围", "2 规范性引用文件", "4 一般要求", "1.1 " + long, "1.2 短", "2.1 " + long, "4.1.1 " + long, "4.2 下列文件" + long, "5.1 " + long, "21.3 " + long,
              "5.2 GB 1234" + long, "5.3 GBX" + long, "6 其他"]
    docs = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    docs += ["# 标题 行 1 范围 1.1 " + long + " <!-- INFO END --> 1.2 " + long, "", None]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    lines = {r["id"]: r["ls"] for r in rows.select("id", la.section_lines("text").alias("ls")).collect()}
    got = {}
    for r in la.parse_section_chapters(rows, "id").orderBy("id", "article_no").collect():
        got.setdefault(r["id"], []).append((r["chapter"], r["num"], r["body"]))
    assert got == {i: plain_sections(ls) for i, ls in lines.items() if ls and plain_sections(ls)}
    assert any(c.endswith("条款") for rows in got.values() for c, _, _ in rows) and any("一般要求" in c for rows in got.values() for c, _, _ in rows)
    assert lines[300] == ["1 范围", "1.1 " + long, "1.2 " + long]


def test_equal_keys_of_two_files(spark, tmp_path):
    """Of equal keys the one in the later file counts, however the files are read."""
    import json

    from clausegraph.sources import corpus
    for name, text in (("b.json", "second"), ("a.json", "first"), ("c.json", None)):
        chapters = [{"chapter_title": "一", "articles": [{"num": "第一条", "title": "", "text": text}]}] if text else None
        (tmp_path / name).write_text(json.dumps({"law_name": "L", "law_abbr": "法", "chapters": chapters}, ensure_ascii=False))
    for paths in ([str(tmp_path / "*.json")], [str(tmp_path / "b.json"), str(tmp_path / "a.json")]):
        rows = corpus.articles(corpus.read_laws(spark, paths)).select("item_id", "text", corpus.law_of("item_id").alias("law_key")).collect()
        assert [tuple(r) for r in rows] == [("法·第一条", "second", "法")]
