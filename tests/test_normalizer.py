"""Goldens of each step of the normaliser, worked out by hand, and its plain twin on odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import normalizer as N
from tests import twins


def said(text, **options):
    return twins.tidied("".join(pieces(text, N.claims(text, N.steps(**options)))))


def pieces(text, claims):
    at = 0
    for a, b, _, spoken in claims:
        yield text[at:a] + spoken
        at = b
    yield text[at:]


GOLDENS = [
    ("HTX, bác BS.", "hợp tác xã, bác bác sĩ."),
    ("thư a.b1@x.com nhé", "thư a chấm b một a còng x chấm com nhé"),
    ("https://www.example.com/a-1 xong", "hếch ti ti pi ét, example chấm com a gạch ngang một xong"),
    ("lãi 8,5%/năm", "lãi tám phảy năm phần trăm trên năm"),
    ("A & B", "A và B"),
    ("xe 29LD-888.99 đỏ", "xe hai chín L D tám tám tám chín chín đỏ"),
    ("biển số xe 30A 123.45, đen", "biển số xe ba không a một hai ba bốn năm , đen"),
    ("tỉ lệ 1:18", "tỉ lệ một mười tám"),
    ("cao 1,75m và 60 km/h", "cao một phảy bảy năm mét và sáu mươi ki lô mét trên giờ"),
    ("5 MPa hay 5 mPa", "năm mê ga pa xcan hay năm mi li pa xcan"),
    ("2 triệu USD", "hai triệu u ét đê"),
    ("ngõ 12/124 đường", "ngõ mười hai trên một trăm hai mươi bốn đường"),
    ("chiếm 2/3 số", "chiếm hai phần ba số"),
    ("1/2 ly", "một phần hai ly"),
    ("nghị định 110/2013", "nghị định một trăm mười , năm hai nghìn không trăm mười ba"),
    ("trường hợp/100.000 dân", "trường hợp trên một trăm nghìn dân"),
    ("3/4 xong", "ba trên bốn xong"),
    ("liên hệ 0912345678 nhé", "liên hệ không chín một hai ba bốn năm sáu bảy tám nhé"),
    ("hotline: 091 234 5678.", "hotline. không chín một hai ba bốn năm sáu bảy tám ."),
    ("10x20 và 2 x 3 x 4", "mười nhân hai mươi và hai nhân ba nhân bốn"),
    ("thắng tỷ số 3-2 trên sân", "thắng tỷ số ba hai trên sân"),
    ("giai đoạn 2020-2024.", "giai đoạn năm hai nghìn không trăm hai mươi đến năm hai nghìn không trăm hai mươi bốn ."),
    ("từ 1/2/2020 - 3/4/2021, xong", "từ ngày một tháng hai năm hai nghìn không trăm hai mươi đến ngày ba tháng bốn năm hai nghìn không trăm hai mươi mốt , xong"),
    ("ngày 5/6/2020", "ngày năm tháng sáu năm hai nghìn không trăm hai mươi"),
    ("mùng 3-4 về", "mùng ba tháng bốn về"),
    ("ngày 21/11 và", "ngày hai mươi mốt trên mười một và"),
    ("sau 5/2021 là", "sau tháng năm năm hai nghìn không trăm hai mươi mốt là"),
    ("mở 9-10h", "mở chín đến mười giờ"),
    ("từ 8h30 - 9h45", "từ tám giờ ba mươi đến chín giờ bốn mươi lăm"),
    ("lúc 08:05 và 9h", "lúc tám giờ năm phút và chín giờ"),
    ("chú ý: xong", "chú ý. xong"),
    ("khoảng 5 - 10 người", "khoảng năm đến mười người"),
    ("2 - 3 người", "hai đến ba người"),
    ("mã số thuế là 0123", "mã số thuế là không một hai ba"),
    ("đội U23, U-19.", "đội U hai mươi ba , U mười chín ."),
    ("thế kỷ XXI, Chương iv và tu vi", "thế kỷ hai mươi mốt , Chương bốn và tu vi"),
    ("nhà A10 và 5G", "nhà a một không và năm gờ"),
    ("x² ≥ 3", "x bình phương lớn hơn hoặc bằng ba"),
    ("lạnh -5 độ", "lạnh âm năm độ"),
    ("1-2-3", "một đến hai - ba"),
    ("text-to-speech", "text to speech"),
    ("12.345,60 và 1.000.000 và 3.14", "mười hai nghìn ba trăm bốn mươi lăm phảy sáu không và một triệu và ba chấm một bốn"),
    ("2,000 và 2,5 và 007", "hai và hai phảy năm và không không bảy"),
    ("tháng tháng năm, mùng ngày hai", "tháng năm, mùng hai"),
    ("một\nhai.\nba", "một. hai. ba"),
    ("(xin) “chào”… [a]", ", xin, chào . a"),
]


@pytest.mark.parametrize("text, want", GOLDENS)
def test_goldens(text, want):
    assert said(text, table={"HTX": "Hợp tác xã", "BS": "bác sĩ"}) == want


def test_strict_reads_dates_before_fractions():
    assert said("ngày 21/11 và 3/4 ly", strict=True) == "ngày hai mươi mốt tháng mười một và ba phần bốn ly"


def test_claims_do_not_overlap_and_equal_the_twin():
    rng = random.Random(4)
    words = [t for t, _ in GOLDENS] + ["từ", "ngày", "/", "-", " ", "5", "12", "1.000", "%", "kg", "h", ":", "\n", "é", "中", "😀", "٣", "x", "+", "(", "—", "IV", "24h30", "sáng", "A1"]
    for _ in range(400):
        text = rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        found = N.claims(text, N.steps({"HTX": "hợp tác xã"}))
        assert found == twins.naive_claims(text, N.steps({"HTX": "hợp tác xã"}))
        assert all(0 <= a <= b <= len(text) for a, b, *_ in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_normalized_column_equals_the_twin(spark):
    texts = [t for t, _ in GOLDENS] + ["", None, "😀 5", "không có số " * 2000 + "12", "a\r\nb\n\nc", "ngày  ngày ngày 3"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumn("kind", F.lit("clash"))
    got = {r.k: r.said for r in N.normalized(rows).collect()}
    assert [got[k] for k in range(len(texts))] == [None if t is None else twins.normalized(t, {}) for t in texts]
    assert N.normalized(rows.limit(0)).count() == 0
