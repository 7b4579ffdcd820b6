"""Form 4 documents: plain ones are read by the batch, others by from_xml, with the same rows."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeline.sources import feeds, plain_xml


def filing(owner="Jane Q", relation="<isDirector>1</isDirector>", lines=(("P", "10", "2.5", "A"),), gap="", more=""):
    val = lambda n, v: f"<{n}><value>{v}</value></{n}>"
    tx = gap.join(
        f"<nonDerivativeTransaction><transactionCoding><transactionCode>{c}</transactionCode></transactionCoding>{gap}<transactionAmounts>"
        f"{val('transactionShares', s)}{val('transactionPricePerShare', p)}{val('transactionAcquiredDisposedCode', a)}</transactionAmounts></nonDerivativeTransaction>"
        for c, s, p, a in lines
    )
    return (
        f"<ownershipDocument>{gap}{more}<reportingOwner><reportingOwnerId><rptOwnerName>{owner}</rptOwnerName></reportingOwnerId>{gap}"
        f"<reportingOwnerRelationship>{relation}</reportingOwnerRelationship></reportingOwner>{gap}<nonDerivativeTable>{tx}</nonDerivativeTable></ownershipDocument>"
    )


FOOTNOTE = '<footnotes><footnote id="F1">see <b/></footnote></footnotes>'
PLAIN = [
    filing(),
    filing(owner="Zoë 名", gap="\n  ", lines=(("P", "10", "n/a", "A"), ("S", "", "1e3", "D"))),
    filing(more="<issuer><value>9</value></issuer><footnoteId id=\"F1\"/>", relation="<officerTitle></officerTitle><isOfficer>true</isOfficer>"),
    '<?xml version="1.0"?>\n' + filing(relation="<officerTitle>CFO</officerTitle>") + "\n",
    filing(lines=()).replace("<nonDerivativeTable></nonDerivativeTable>", ""),
]
ODD = [
    filing(owner="A &amp; B"),
    filing(owner=" padded "),
    filing(owner="<![CDATA[x < y]]>"),
    filing(owner="a > b"),
    filing(more="<!-- note -->"),
    filing(more="loose text"),
    filing(more=FOOTNOTE),
    filing(more="<n:a xmlns:n='u'/>"),
    filing(relation="<isOfficer>1</isOfficer><isOfficer>0</isOfficer>"),
    filing(relation="<isofficer>1</isofficer>"),
    filing(relation="<isDirector/>"),
    filing().replace("</reportingOwner>", "</reportingOwner><reportingOwner></reportingOwner>"),
    filing().replace("</value>", "</valve>", 1),
    filing()[:-5],
    filing()[30:],
    filing() + "<a/>",
    "<a>",
    "",
    None,
]


def reader():
    schema = StructType.fromDDL(feeds._FORM4)
    return schema, plain_xml.tree_of(schema)


def test_plain_documents_are_read_by_the_batch(spark):
    _, tree = reader()
    docs = [d for pair in zip(PLAIN * 4, ODD + [None], strict=True) for d in pair]
    got = plain_xml.read(pa.array(docs, pa.string()), tree).to_pylist()
    assert [g is not None for g in got] == [True, False] * len(PLAIN * 4)
    assert got[2]["reportingOwner"]["reportingOwnerId"] == {"rptOwnerName": "Zoë 名"}
    lines = got[2]["nonDerivativeTable"]["nonDerivativeTransaction"]
    assert [x["transactionCoding"]["transactionCode"] for x in lines] == ["P", "S"]
    assert lines[1]["transactionAmounts"] == {"transactionShares": {"value": ""}, "transactionPricePerShare": {"value": "1e3"}, "transactionAcquiredDisposedCode": {"value": "D"}}


def test_pieces_of_a_batch_make_no_difference(spark, monkeypatch):
    _, tree = reader()
    column = pa.array([*PLAIN, *ODD, *PLAIN], pa.string())
    whole = plain_xml.read(column, tree).to_pylist()
    monkeypatch.setattr(plain_xml, "CHUNK", 700)
    assert plain_xml.read(column, tree).to_pylist() == whole
    assert plain_xml.read(column.slice(3, 9), tree).to_pylist() == whole[3:12]
    assert plain_xml.read(column.slice(0, 0), tree).to_pylist() == []


def test_rows_are_those_of_from_xml(spark, monkeypatch):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(PLAIN + ODD)], "id long, xml string")
    got = sorted(map(tuple, feeds.parse_form4(df).collect()))
    assert [r[1:] for r in got if r[0] < 4] == [
        ("P", 10.0, 2.5, "A", "Jane Q", "Director"),
        ("P", 10.0, 0.0, "A", "Zoë 名", "Director"),
        ("S", 0.0, 1000.0, "D", "Zoë 名", "Director"),
        ("P", 10.0, 2.5, "A", "Jane Q", "Officer"),
        ("P", 10.0, 2.5, "A", "Jane Q", "CFO"),
    ]
    monkeypatch.setattr(feeds, "_form4", lambda xml: F.from_xml(xml, feeds._FORM4))
    assert got == sorted(map(tuple, feeds.parse_form4(df).collect()))


def test_plain_documents_of_the_query_leave_nothing_to_from_xml(spark):
    from tapeline.plans import feeds as plans

    d = "/root/testdata/sf0.001"
    schema, tree = reader()
    plain = F.arrow_udf(lambda x: plain_xml.read(x, tree), schema)
    assert plans.filings(spark, d).where(plain("xml").isNull()).count() == 0
