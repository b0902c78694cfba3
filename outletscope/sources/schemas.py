"""Declared schemas of the domain tables. NOT NULL columns are keys the operators rely on."""

from __future__ import annotations

from pyspark.sql.types import DataType, DateType, DecimalType, IntegerType, LongType, StringType, StructType

BIGINT, INT, STRING, DATE = LongType(), IntegerType(), StringType(), DateType()
MONEY, RATE = DecimalType(12, 2), DecimalType(5, 2)


def _schema(keys: dict[str, DataType], **columns: DataType) -> StructType:
    schema = StructType()
    for name, kind in keys.items():
        schema.add(name, kind, nullable=False)
    for name, kind in columns.items():
        schema.add(name, kind)
    return schema


# monthly or line-level sales: several rows per outlet, article and month add up
_SALES = _schema({"outlet_id": BIGINT, "article_id": BIGINT, "period": INT}, qty=BIGINT)

SCHEMAS: dict[str, StructType] = {
    "sales": _SALES,
    "collection": _SALES,  # the second sales fact, read by the molecule scorecard
    "article": _schema({"article_id": BIGINT}, maker_lab=STRING, type=STRING, stopped_on=DATE),
    "offer": _schema(
        {"article_id": BIGINT, "link_id": STRING}, lab=STRING, rebate=RATE, valid_until=DATE, type=STRING, price=MONEY
    ),
    "link_group": _schema(
        {"link_id": STRING, "group_id": STRING},
        short_label=STRING,
        pack=STRING,
        volume=STRING,
        unit=STRING,
        group_price=MONEY,
    ),
    "article_group": _schema({"article_id": BIGINT, "group_id": STRING}),
    "dci": _schema({"group_id": STRING, "dci": STRING}, dose=STRING, form=STRING),
    "lab": _schema({"lab": STRING}, lab_name=STRING),
    "ean": _schema({"ean": BIGINT, "article_id": BIGINT}),
    "excluded_ean": _schema({"ean": BIGINT}),
    "launch_ean": _schema({"ean": BIGINT}),
    "regulated_price": _schema({"article_id": BIGINT}, price=MONEY, active=INT),
    "outlet": _schema({"outlet_id": BIGINT}, name=STRING, postcode=STRING, town=STRING),
    "crm": _schema({"outlet_id": BIGINT}, code=STRING),
    "outlet_master": _schema({"outlet_id": BIGINT}, finess=STRING),
    "member": _schema({"finess": STRING}, mail=STRING),
    "completeness": _schema({"outlet_id": BIGINT, "period": INT}, ok=INT),
    "outlet_group": _schema({"outlet_id": BIGINT, "group_no": INT}),
}


def key_columns(table: str) -> list[str]:
    return [field.name for field in SCHEMAS[table].fields if not field.nullable]
