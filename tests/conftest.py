from __future__ import annotations

import io
import sys
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        # Tiny inputs: compiling the plans would take longer than running them.
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.default.parallelism", "2").config("spark.sql.adaptive.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def _cell(value, ref: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, tuple):
        kind, raw = value
        return {"date": f'<c r="{ref}" s="1"><v>{raw}</v></c>', "custom": f'<c r="{ref}" s="2"><v>{raw}</v></c>',
                "error": f'<c r="{ref}" t="e"><v>{raw}</v></c>', "shared": f'<c r="{ref}" t="s"><v>{raw}</v></c>',
                "formula": f'<c r="{ref}"><f>1+1</f><v>{raw}</v></c>'}[kind]
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def workbook_bytes(sheets: dict[str, list[list]], shared: list[str] = (), date1904: bool = False) -> bytes:
    """A minimal workbook; a row of None is left out of the file."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        props = '<workbookPr date1904="1"/>' if date1904 else ""
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}">{props}<sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                   'relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>'
                                               for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts count="1"><numFmt numFmtId="170" formatCode="dd\\-mm\\-yyyy hh:mm"/>'
                   '</numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(_cell(v, f"{chr(65 + c)}{r}") for c, v in enumerate(row)) + "</row>"
                           for r, row in enumerate(rows, 1) if row is not None)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture
def make_workbook():
    def write(path: Path, sheets, **kw) -> Path:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(workbook_bytes(sheets, **kw))
        return path

    return write


@pytest.fixture
def put():
    def write(path: Path, text: str) -> Path:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return path

    return write
