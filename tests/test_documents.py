"""Literal documents: headers, headings, persons, citations, titles, chunks, keyboards."""

import struct

import pytest
from pyspark.sql import functions as F

from docketry.functions import frontmatter as FM
from docketry.functions import text as T
from docketry.functions import vector as V
from docketry.operators import citations, fts, fusion, persons, segments
from docketry.plans import indexing

LAW = """---
제목: 갈대법
법령MST: 310022
법령ID: '000451'
법령구분: 법률
소관부처:
- 호수청
공포일자: '2019-08-05'
시행일자: '2019-11-01'
상태: 시행
출처: https://example.org/법령/갈대법
---
# 갈대법
"""


def value(spark, text, expr):
    return spark.createDataFrame([(text,)], "raw string").select(expr(F.col("raw")).alias("x")).first().x


def test_frontmatter(spark):
    h = value(spark, LAW, FM.parse_frontmatter)
    assert {k: (h[k].list, h[k].v) for k in ("제목", "소관부처", "법령ID")} == {"제목": (False, ["갈대법"]), "소관부처": (True, ["호수청"]), "법령ID": (False, ["000451"])}
    assert value(spark, LAW, lambda c: FM.scalar(FM.parse_frontmatter(c), "소관부처")) == "" and value(spark, LAW, lambda c: FM.values(FM.parse_frontmatter(c), "소관부처")) == ["호수청"]
    assert value(spark, "no header", FM.parse_frontmatter) == {}
    nested = value(spark, "---\n관할:\n  광역: 물빛도\n  기초: 솔숲군\nx:\n  - a\n  - b\n# note: y\nx2: \"q\"\n---\nbody", FM.parse_frontmatter)
    assert {k: x.v for k, x in nested.items()} == {"광역": ["물빛도"], "기초": ["솔숲군"], "x": ["a", "b"], "x2": ["q"], "관할": [""]} and not nested["관할"].list


@pytest.mark.parametrize(("raw", "rest"), [("---\na: 1\n---\nbody", "body"), ("---\na: 1\n---", "---\na: 1\n---"), ("---\nopen", "---\nopen"), ("plain", "plain"), ("", "")])
def test_strip_frontmatter(spark, raw, rest):
    assert value(spark, raw, FM.strip_frontmatter) == rest


def test_lines(spark):
    assert value(spark, "a\r\nb\n\nc\n", FM.lines) == ["a", "b", "", "c"]
    assert value(spark, "", FM.lines) == []


def test_articles(spark):
    docs = spark.createDataFrame([("d", "##### 제1조 (목적)\nSome **text**\n##### 제2조 (정의)\nMore text"), ("e", ""), ("n", None)], "id string, raw string")
    rows = segments.extract(docs, "article").orderBy("idx").collect()
    assert [(r.label, r.line_index, r.text) for r in rows] == [("제1조 (목적)", 0, "제1조 (목적)\nSome text"), ("제2조 (정의)", 2, "제2조 (정의)\nMore text")]


def test_sections(spark):
    raw = "---\na: 1\n---\n# 소유권이전등기등\n\n## 판시사항\n\n[1] Some text\n\n## 판결요지\n\n[1] More text\n\n## 판례내용\n\nFull text here"
    docs = spark.createDataFrame([("d", raw)], "id string, raw string")
    assert [r.label for r in segments.extract(docs, "section").orderBy("idx").collect()] == ["판시사항", "판결요지", "판례내용"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("대법관 도바람(재판장) 서이슬(주심) 문가람 나들녘", [("도바람", "judge", "재판장"), ("서이슬", "judge", "주심"), ("문가람", "judge", None), ("나들녘", "judge", None)]),
        ("판사 유소담(재판장) 우다솜 하늘봄", [("유소담", "judge", "재판장"), ("우다솜", "judge", None), ("하늘봄", "judge", None)]),
        ("원고 (소송대리인 변호사 오솔길)\n피고 (소송대리인 변호사 남도래)", [("오솔길", "attorney", None), ("남도래", "attorney", None)]),
        ("【변 호 인】   변호사 구름빛 외 5인", [("구름빛", "attorney", None)]),
        ("【검    사】 배산들 외 1인", [("배산들", "prosecutor", None)]),
        ("변호사 오솔길\n변호사 오솔길", [("오솔길", "attorney", None)]),
        ("", []),
    ],
)
def test_persons(spark, raw, expected):
    assert [tuple(p) for p in value(spark, raw, persons.persons_of)] == expected


def test_names(spark):
    rows = spark.createDataFrame([(x,) for x in ("도바람", "이름", "대법원", "A", "가", "abcde", "김a수")], "x string")
    assert [r.ok for r in rows.select(persons.is_name(F.col("x")).alias("ok")).collect()] == [True, True, True, False, False, False, False]
    assert persons.stale(106, 100) and not persons.stale(104, 100)
    with pytest.raises(ValueError, match="role"):
        persons.search(rows, "x", "clerk")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("민법 제12조 제4호, 민법 제15조", [("민법", "제12조", "제4호", None), ("민법", "제15조", None, None)]),
        ("[1] 민법 제21조, 제34조 / [2] 민법 제21조, 제34조", [("민법", "제21조", None, 1), ("민법", "제34조", None, 1), ("민법", "제21조", None, 2), ("민법", "제34조", None, 2)]),
        ("민법 제41조 제1항, 제42조, 제43조, 제44조", [("민법", "제41조", "제1항", None), ("민법", "제42조", None, None), ("민법", "제43조", None, None), ("민법", "제44조", None, None)]),
        ("구 갯벌세법(2003. 4. 2. 법률 제7001호로 개정되기 전의 것) 제8조 제2항", [("구 갯벌세법", "제8조", "제2항", None)]),
        ("제12조 제4호, 민법 제15조", [("민법", "제15조", None, None)]),
        ("[1] 집합법 제47조 제1항, 제2항, 제48조", [("집합법", "제47조", "제1항", 1), ("집합법", "제47조", "제2항", 1), ("집합법", "제48조", None, 1)]),
        ("[1][2] 형법 제1조", [("형법", "제1조", None, 1), ("형법", "제1조", None, 2)]),
    ],
)
def test_statutes(spark, text, expected):
    assert [tuple(r) for r in value(spark, f"## 참조조문\n\n{text}\n\n## 판례내용\n\n민법 제1조", citations.statute_refs)] == expected


def test_statutes_missing_and_strict(spark):
    assert value(spark, "## 판례내용\n\n민법 제1조", citations.statute_refs) == []
    strict = value(spark, "## 참조조문\n\n국제사법 제2조", lambda c: citations.statute_refs(c, strict=True))
    assert [tuple(r) for r in strict] == [("국제사법", "제2조", None, None)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("대법원 2007. 3. 9. 선고 2006다80412 판결", [("대법원", "2006다80412", "2007-03-09", [])]),
        ("[1] 대법원 1991. 5. 8. 선고 90다카2207 판결(공1991, 77) / [2] 대법원 2001. 12. 4. 선고 99다60018 판결(공2001하, 9)", [("대법원", "90다카2207", "1991-05-08", [1]), ("대법원", "99다60018", "2001-12-04", [2])]),
        ("대법원 2007. 3. 9. 선고 2000다1 판결, 헌법재판소 2000. 2. 24. 98헌바94 결정", [("대법원", "2000다1", "2007-03-09", []), ("헌법재판소", "98헌바94", "2000-02-24", [])]),
        ("서울고법 2007. 3. 9. 선고 2000나1 판결", []),
    ],
)
def test_cases(spark, text, expected):
    assert [tuple(r) for r in value(spark, f"## 참조판례\n\n{text}\n", citations.case_refs)] == expected


def test_matching(spark):
    names = spark.createDataFrame([(x,) for x in ("민법", "구 갯벌세법", "완전히없는법률", "집합건물 소유법", "")], "law_name string")
    titles = spark.createDataFrame([(x,) for x in ("민법", "갯벌세법", "집합건물소유법시행", "")], "title string")
    got = {r.law_name: (r.match_type, r.law_id) for r in citations.match_laws(names, titles).collect()}
    assert got == {"민법": ("Exact", "kr/민법/법률"), "구 갯벌세법": ("OldVersion", "kr/갯벌세법/법률"), "완전히없는법률": ("Unmatched", None), "집합건물 소유법": ("Substring", "kr/집합건물소유법시행/법률")}


def test_long_names(spark):
    """Work is linear in a name's length: one malformed name must not stop a job."""
    long = "가나다라마바사" * 28_000 + "호수법" + "아자차카" * 1000
    names = spark.createDataFrame([(long,), ("숲" * 3000,), ("긴 이름",)], "law_name string")
    titles = spark.createDataFrame([("호수법",), ("새 긴이름에 관한 " + "법" * 300,), ("없는법",)], "title string")
    got = {r.law_name[:3]: (r.match_type, r.law_id and r.law_id[:8]) for r in citations.match_laws(names, titles).collect()}
    assert got == {"가나다": ("Substring", "kr/호수법/법"), "숲숲숲": ("Unmatched", None), "긴 이": ("Substring", "kr/새 긴이름")}


def test_contained(spark):
    import random

    rng = random.Random(5)
    text = lambda a, b: "".join(rng.choice("가나다") for _ in range(rng.randint(a, b)))
    short, long = {text(1, 6) for _ in range(60)} | {"가나다" * 30}, {text(1, 80) for _ in range(60)} | {"라" + "가나다" * 40}
    frames = [spark.createDataFrame([(x,) for x in sorted(v)], f"{c} string") for v, c in ((short, "s"), (long, "l"))]
    assert sorted(map(tuple, citations.contained(*frames).collect())) == sorted((x, y) for x in short for y in long if x in y)


MARKUP = [
    ("① 첫 글\n1. 호\n---\n##제목", "\n#pad(left: 1em)[① 첫 글]\n#pad(left: 2.5em)[1. 호]\n#line(length: 100%)\n== 제목\n"),
    ("글\n\n② **굵게** $\n2.\n글\n2. x", "글\n\n#pad(left: 1em)[② *굵게* \\$]\n#pad(left: 2.5em)[2.]\n글\n2. x\n"),
    ("\n㉑ a", "\n\n#pad(left: 1em)[㉑ a]\n"), ("####### x@y", "====== \\# x\\@y\n".replace("\\# x", "\\# x")), ("", ""), ("1. a <b>", "1. a \\<b\\>\n"), ("***", "#line(length: 100%)\n"), ("****", "**\n"),
]


@pytest.mark.parametrize(("raw", "markup"), MARKUP)
def test_markup(spark, raw, markup):
    from docketry.sources import sinks

    assert value(spark, raw, sinks.to_markup) == markup


@pytest.mark.parametrize(("raw", "title"), [('---\ntitle: "Reed Act"\n---\n# Other', "Reed Act"), ("# Marsh Notes\ntext", "Marsh Notes"), ("plain first line\nmore", "plain first line"), ("", "Untitled"), ("---\nopen: 1", "Untitled"), ("---\n제목: 민법\n---\n\n## 민법 제목", "민법 제목"), ("#\n#nospace", "#")])
def test_title(spark, raw, title):
    assert value(spark, raw, T.extract_title) == title


def test_embedding_input(spark):
    assert value(spark, "  hello   world  \n  foo  ", T.normalize_embedding_text) == b"hello world foo"
    assert value(spark, "abcdefgh", lambda c: T.normalize_embedding_text(c, 5)) == b"abcde"
    assert value(spark, "hello  world", T.passage) == b"passage: hello world"
    v = value(spark, "한국어", lambda c: V.fnv_embed(c.cast("binary")))
    h = 2166136261
    for b in "한국어".encode():
        h = (h + b) * 16777619 % 2**32
    raw = [((h + i) * 16777619 % 2**32 & 0xFFFF) / 65535 - 0.5 for i in range(384)]
    norm = sum(x * x for x in raw) ** 0.5
    assert len(v) == 384 and max(abs(a - b / norm) for a, b in zip(v, raw)) < 1e-12


def test_chunks():
    assert [len(c) for c in indexing.chunk(b"x" * 10000)] == [3600, 3060, 3340]
    assert indexing.chunk(b"") == [b""] and indexing.chunk(b"y" * 100) == [b"y" * 100]
    text = b"\n".join(b"a line of some length %d" % k for k in range(900))
    assert b"".join(indexing.chunk(text)) == text and max(map(len, indexing.chunk(text))) <= 3600


@pytest.mark.parametrize(("keys", "hangul"), [("als", "민"), ("alsqjq", "민법"), ("gksrmf", "한글"), ("rhk", "과"), ("rksk", "가나"), ("123", None), ("r1k", "ㄱ1ㅏ"), (None, None)])
def test_keyboard(keys, hangul):
    assert T.eng_to_hangul(keys) == hangul


def test_jamo():
    out, seen = "민", []
    while out:
        out = T.pop_jamo(out)
        seen.append(out)
    assert seen == ["미", "ㅁ", ""]
    assert T.display_width("민a") == 3 and T.fit_width("민법민법", 5) == "민법…" and T.fit_width("a", 3) == "a  "


@pytest.mark.parametrize(("text", "out"), [("hello world", "hello world"), ("auth -test", "auth -test"), ("auth*", "auth*"), ("auth-flow", '"auth-flow"'), ("-foo-bar*", '-"foo-bar"*'), ("   ", ""), ("제1조,제2조", "제1조 제2조"), ("민법(제750조)", '"민법(제750조)"'), ('"hello"', '"""hello"""')])
def test_query_string(text, out):
    assert fts.build_query_string(text) == out


def test_porter():
    assert [fts.porter(w) for w in ("returning", "caresses", "ponies", "relational", "hopping", "sky", "happy", "보증금")] == ["return", "caress", "poni", "relat", "hop", "sky", "happi", "보증금"]


def test_rrf(spark):
    lists = [spark.createDataFrame(x, "id long, rank int") for x in ([(1, 1), (2, 2)], [(2, 1)])]
    assert [r.id for r in fusion.rrf(*lists).orderBy(F.desc("score")).collect()] == [2, 1]


def test_vector_edges(spark):
    df = spark.createDataFrame([("[1, 2.5]",), ("[]",), ("x",), ("[1, 300]",), (None,)], "t string")
    rows = df.select(V.vec_f32(F.col("t")).alias("f"), V.vec_int8(F.col("t")).alias("i")).collect()
    assert [r.f for r in rows] == [[1.0, 2.5], None, None, [1.0, 300.0], None]
    assert rows[3].i is None and rows[1].i is None
    two = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = two.select(V.distance_l2(F.col("a"), F.col("b")).alias("l2"), V.distance_cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0].l2 == pytest.approx(5**0.5) and got[0].c is None and got[1].l2 is None and got[2].l2 is None
    small = spark.createDataFrame([([120, -128], [10, -1])], "a array<tinyint>, b array<tinyint>")
    assert small.select(V.vec_add_int8(F.col("a"), F.col("b")).alias("x")).first().x == [-126, 127]


def test_contained_broadcasts_nothing(spark, tmp_path):
    """A file's size says little of the rows that its texts become: no side is broadcast for being a small file."""
    spark.createDataFrame([("갈대법",), ("법",), ("바다 시행법",)], "t string").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    got = citations.contained(t.select(t.t.alias("s")), t.select(t.t.alias("l")))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("갈대법", "갈대법"), ("바다 시행법", "바다 시행법"), ("법", "갈대법"), ("법", "바다 시행법"), ("법", "법")]


def test_vector_json_halves(spark):
    """Halves at the seventh decimal go to the even digit, as in C; binary numbers with one are odd 128ths."""
    values = [k / 128 for k in range(-300, 300)] + [123456.7890625, -0.0, -1e-7, 5e-7, 0.1234565, 1e9]
    df = spark.createDataFrame([(values,), (None,)], "v array<float>")
    single = [struct.unpack("f", struct.pack("f", v))[0] for v in values]
    assert [r.j for r in df.select(V.vec_to_json(F.col("v")).alias("j")).collect()] == ["[" + ",".join(f"{v:.6f}" for v in single) + "]", None]


def test_store_is_incremental(spark, tmp_path):
    store = indexing.Store(spark, str(tmp_path / "store"))
    files = lambda rows: spark.createDataFrame([("c", p, t, len(t), m) for p, t, m in rows], "collection string, path string, text string, size long, mtime long")
    store.index(files([("a", "# A\none", 1), ("b", "# B\ntwo", 1)]), 1)
    changed = store.index(files([("a", "# A\none", 1), ("b", "# B\ntwo", 2), ("c", "# A\none", 1), ("d", "# D\nnew", 1)]), 2)
    assert sorted(r.path for r in changed.collect()) == ["b", "c", "d"] or store.count("c") == 4
    assert store.count("c") == 4 and store.read("content", store.CONTENT).count() == 3
    store.index(files([("a", "# A\none", 1)]), 3, tombstones=True)
    assert store.count("c") == 1
    assert {r.title for r in store.documents().collect()} == {"A"}


def test_long_documents(spark):
    """Many headings, references, marks and persons in one document: work is linear, and no pattern runs out of stack."""
    one = lambda raw: spark.createDataFrame([(1, raw)], "id long, raw string")
    n = 20_000
    rows = segments.extract(one("".join(f"## 부분{i}\n\n글{i}\n" for i in range(n))), "section").orderBy("idx").collect()
    assert [(r.label, r.line_index, r.text) for r in rows] == [(f"부분{i}", 3 * i, f"부분{i}\n글{i}") for i in range(n)]
    parts = ", ".join("가법 제1조 제2항" if i % 1000 == 0 else "제3항" if i % 2 else f"제{i}조" for i in range(n))
    got = citations.extract_statutes(one(f"## 참조조문\n\n{parts}\n")).orderBy("pos").collect()
    article = lambda i: "제1조" if i % 1000 == 0 else f"제{i}조"
    assert [(r.law_name, r.article, r.detail) for r in got] == [("가법", article(i - i % 2), "제3항" if i % 2 else "제2항" if i % 1000 == 0 else None) for i in range(n)]
    marked = citations.extract_statutes(one(f"## 참조조문\n\n{'[1] ' * 20000}가법 제1조\n"))
    assert marked.count() == 20000
    names = [chr(0xAC00 + i % 500) + chr(0xAC00 + i // 500) for i in range(5000)]
    found = persons.extract(one(f"판사 {' '.join(names + names[::-1])}\n(변호사 {'가' * 50000})\n")).orderBy("pos").collect()
    assert [r.name for r in found] == names and {r.role for r in found} == {"judge"}
