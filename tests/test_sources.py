"""Files as exports: every layout is written here from the same small garden-shop table."""

import csv
import io
import random

import pytest

from termloom.errors import InputError
from termloom.operators.prepare import prepare_keywords
from termloom.sources import files, roles

HEADER = ["Keyword", "Volume", "URL"]
LINES = [
    ["raised bed kit", "420", "https://garden.example/beds"],
    ["slug proof plants", "77", "https://garden.example/slugs"],
    ["häcksler leihen", "13", ""],
]


def table(header=HEADER, lines=LINES, delimiter=","):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\n").writerows([header, *lines])
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    def write(**contents):
        for name, content in contents.items():
            (tmp_path / name).write_bytes(content)
        return str(tmp_path)

    return write


def read(spark, path, **how):
    return files.read_keyword_exports(spark, path, **how).orderBy("row_ord")


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16"])
def test_every_layout_gives_the_same_rows(spark, folder, delimiter, encoding):
    got = read(spark, folder(shop=table(delimiter=delimiter).encode(encoding)))
    assert got.columns[:3] == HEADER
    want = [tuple(cell or None for cell in line) for line in LINES]
    assert [tuple(r)[:3] for r in got.collect()] == want


def test_other_single_byte_text_is_decoded(spark, folder):
    lines = [[f"größe {i} für töpfe", str(i), ""] for i in range(40)]
    got = read(spark, folder(shop=table(lines=lines).encode("latin-1"))).collect()
    assert got[7]["Keyword"] == "größe 7 für töpfe" and len(got) == 40


def test_a_single_column_needs_no_delimiter(spark, folder):
    got = read(spark, folder(shop=b"Keyword\nmulch\nperlite\ncompost\n"))
    assert got.columns[:1] == ["Keyword"] and got.count() == 3


def test_quoted_breaks_and_quotes_stay_in_their_cell(spark, folder):
    odd = ['say "mulch", twice', "over\ntwo lines", "plain"]
    got = read(spark, folder(shop=table(lines=[[k, "1", ""] for k in odd]).encode()))
    assert [r["Keyword"] for r in got.collect()] == odd


def test_rows_longer_than_the_header_go_shorter_ones_are_padded(spark, folder):
    got = read(spark, folder(shop=b"Keyword,Volume,URL\nfork\nspade,8,u\nrake,9,u,too,many\nhoe,,\n"))
    assert [tuple(r)[:3] for r in got.collect()] == [
        ("fork", None, None), ("spade", "8", "u"), ("hoe", None, None)
    ]


def test_layouts_are_put_together_in_file_order(spark, folder):
    path = folder(
        **{"1": table(["Keyword", "Volume"], [["pots", "5"]]).encode(),
           "2": table(["Keyword", "KD"], [["vases", "31"]], ";").encode(),
           "3": table(["Keyword", "Volume"], [["trays", "6"]]).encode()}
    )
    got = [(r["row_ord"], r["Keyword"], r["Volume"], r["KD"]) for r in read(spark, path).collect()]
    assert got == [(0, "pots", "5", None), (1, "vases", None, "31"), (2, "trays", "6", None)]


@pytest.fixture
def short_ranges(spark):
    """Files are cut every few hundred bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    for name in names:
        spark.conf.set(name, "400")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-16", "cp1252"])
def test_ranges_begin_inside_quoted_cells(spark, folder, short_ranges, encoding):
    """Breaks, delimiters and doubled quotes in cells, over many more ranges than records."""
    odd = ["one; two\nthree, \"four\"\nfive", "plain", "\n\n", "a,b,c\n" * 20 + '"end"', 'tail"', "größe\r\nübrig"] * 4
    lines = [[k, str(i), f"u{i}\nv" if i % 3 else ""] for i, k in enumerate(odd)]
    got = read(spark, folder(shop=table(["Keyword", "Vol\nume", "URL"], lines, ";").encode(encoding)))
    assert got.columns[:3] == ["Keyword", "Vol\nume", "URL"]
    cell = lambda x: x.replace("\r\n", "\n") or None
    want = [(cell(k), v, cell(u)) for k, v, u in lines]
    assert [tuple((c or "").replace("\r\n", "\n") or None for c in tuple(r)[:3]) for r in got.collect()] == want
    assert [r["row_ord"] for r in got.collect()] == list(range(len(lines)))


def test_ranges_of_files_without_quotes(spark, folder, short_ranges):
    lines = [[f"pot {i}", str(i), ""] for i in range(60)]
    path = folder(**{f"f{n}": table(lines=lines[20 * n : 20 * n + 20]).encode() for n in range(3)})
    assert [(r["row_ord"], r["Keyword"]) for r in read(spark, path).collect()] == [
        (i, f"pot {i}") for i in range(60)]


def test_the_delimiter_is_judged_over_all_lines(spark, folder):
    """A quoted cell of more than 64 K characters full of other delimiters comes first."""
    note = "so, here, are, many | words\nand, more, of, them\n" * 3_000
    lines = [[note, "1", "x"], *([f"pot {i}", str(i), ""] for i in range(30))]
    got = read(spark, folder(shop=table(lines=lines, delimiter=";").encode()))
    rows = got.collect()
    assert len(rows) == 31 and rows[0]["Keyword"] == note and rows[30]["Volume"] == "29"


def test_quotes_inside_a_plain_cell_open_nothing(spark, folder):
    path = folder(shop=b'Keyword,Volume\npipe 5" wide,1\nhose,2\npipe 7" wide,3\n"a ""b""\nc",4\n')
    assert [tuple(r)[:2] for r in read(spark, path).collect()] == [
        ('pipe 5" wide', "1"), ("hose", "2"), ('pipe 7" wide', "3"), ('a "b"\nc', "4")]


def test_steps_compose(spark):
    """Running composition against taking the lines one by one."""
    rng = random.Random(3)
    rows = [(p, b, r, rng.choice([0, 0, 1, 2, 3])) for p in "xy" for b in range(7) for r in range(rng.randint(1, 9))]
    table = spark.createDataFrame(rows, "path string, block long, row long, step int").repartition(5)
    got = {(r["path"], r["block"], r["row"]): r["inside"] for r in files.with_quote_state(table).collect()}
    state = {}
    for p, b, r, step in sorted(rows):
        now = state.get(p, False)
        assert got[p, b, r] == now
        state[p] = [now, not now, False, True][step]


# The first bytes that mark the two kinds of workbooks are fixed values.
WORKBOOKS = {"xlsx": bytes.fromhex("504B0304"), "xls": bytes.fromhex("D0CF11E0A1B11AE1")}


def test_kinds_come_from_the_first_bytes(spark, folder):
    path = folder(
        **{"a.tsv": WORKBOOKS["xlsx"] + b" and more", "b.txt": WORKBOOKS["xls"] + b" and more",
           "c.csv": b"", "d.csv": b"\n\n \t\n", "e.xlsx": table().encode()}
    )
    profile = files.profile_files(spark, path)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["error_code"]) for r in profile.collect()}
    assert got == {
        "a.tsv": ("xlsx", "WORKBOOK_NOT_SUPPORTED"), "b.txt": ("xls", "WORKBOOK_NOT_SUPPORTED"),
        "c.csv": ("text", "EMPTY_FILE"), "d.csv": ("text", "EMPTY_FILE"), "e.xlsx": ("text", None),
    }
    assert files.unreadable_files(profile).count() == 4


def test_unreadable_files_are_never_dropped_silently(spark, folder):
    path = folder(good=table().encode(), book=WORKBOOKS["xlsx"] + b"x", nothing=b"")
    with pytest.raises(InputError) as error:
        files.read_keyword_exports(spark, path)
    assert {code for _, code in error.value.context["files"]} == {"WORKBOOK_NOT_SUPPORTED", "EMPTY_FILE"}
    assert read(spark, path, on_error="skip").count() == len(LINES)


def test_a_header_beyond_the_parser_is_reported(spark, folder):
    path = folder(huge=b'"' + b"x" * 200_000 + b'",Volume\n1,2\n')
    codes = [r["error_code"] for r in files.profile_files(spark, path).collect()]
    assert codes == ["UNPARSEABLE_FILE"]


def test_only_an_empty_file(spark, folder):
    with pytest.raises(InputError) as error:
        files.read_keyword_exports(spark, folder(nothing=b""), on_error="skip")
    assert error.value.code == "EMPTY_FILE"


def test_repeated_and_missing_headers_get_names():
    header = ["pot", "", "pot", "\tpan ", "pot"]
    assert files.header_names(header) == ["pot", "Unnamed: 1", "pot.1", "pan", "pot.2"]


def test_roles_follow_the_headers(keywords):
    df = keywords(**{"Keyword": ["hoses"], "Volume": [3], "Position": [2.5], "note": ["x"]})
    rows, mapping = prepare_keywords(df, row_ord="row_ord")
    assert mapping == {"keyword": "Keyword", "volume": "Volume", "difficulty": None,
                       "position": "Position", "url": None}
    assert (rows.first()["volume"], rows.first()["position"]) == (3.0, 2.5)


def test_requested_column_wins(keywords):
    df = keywords(**{"Search  Phrase": ["hoses"], "keyword": ["taps"], "volume": [1]})
    mapping = roles.resolve_columns(df, {"keyword": "search phrase"})
    assert mapping["keyword"] == "Search  Phrase" and mapping["volume"] == "volume"


def test_missing_keyword_column_lists_what_is_there(spark):
    with pytest.raises(InputError) as error:
        roles.resolve_columns(spark.createDataFrame([(1, 2)], "height int, width int"))
    assert error.value.code == "KEYWORD_COLUMN_NOT_FOUND"
    assert error.value.context["columns_detected"] == ["height", "width"]


def test_preview(keywords):
    df = keywords(keyword=[f"plant {i}" for i in range(27)], volume=[float("inf")] * 27)
    facts = roles.preview(df)
    assert facts["row_count"] == 27 and len(facts["sample_rows"]) == 20
    assert facts["sample_rows"][3]["volume"] is None
    assert roles.preview_rows(df, "row_ord", 5).count() == 5


def test_checks(keywords):
    df = keywords(keyword=["ivy", None, "none", "  ", "ø", "!!"])
    got = {r["check"]: (r["failed_rows"], r["passed"]) for r in roles.input_checks(df, "keyword").collect()}
    assert got["has_rows"] == (0, True) and got["has_keyword_column"] == (0, True)
    assert got["has_keywords"][1] and 0 < got["has_keywords"][0] < 6
    absent = {r["check"]: r["passed"] for r in roles.input_checks(df, "phrase").collect()}
    assert absent == {"has_rows": True, "has_keywords": False, "has_keyword_column": False}
    with pytest.raises(InputError) as error:
        roles.require_usable(keywords(keyword=["!!", "-"]), "keyword")
    assert error.value.code == "NO_KEYWORDS"


def test_checks_count_unreadable_files(spark, folder, keywords):
    profile = files.profile_files(spark, folder(good=table().encode(), book=WORKBOOKS["xls"] + b"x"))
    found = roles.input_checks(keywords(keyword=["ivy"]), "keyword", profile).where("code = 'UNPARSEABLE_FILE'")
    assert [(r["failed_rows"], r["passed"]) for r in found.collect()] == [(1, False)]
