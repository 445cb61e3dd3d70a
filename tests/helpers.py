"""Small input rows for the tests."""

from cohortlens import constants as C
from cohortlens import schemas

#: One accepted row: an invented van that rattled a month before it was reported.
PLAIN_ROW = dict(
    PROD_TYPE="V", CMPLID="1805", ODINO="7001", MAKETXT="Quillon", MODELTXT="Tern 9", YEARTXT="2011",
    TRANS_TYPE="MAN", DRIVE_TRAIN="RWD", COMPDESC="STEERING", CDESCR="The column rattles on cobbles at walking pace.",
    MILES="60210", FAILDATE="20150514", LDATE="20150613", CRASH="N", FIRE="N", DEATHS="0", INJURED="0",
)


def complaint(**over):
    row = PLAIN_ROW | over
    return tuple(row.get(n) or None for n in C.COMPLAINT_COLUMNS)


def complaints(spark, *overrides):
    return spark.createDataFrame([complaint(**o) for o in overrides], schemas.COMPLAINT_SOURCE)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
