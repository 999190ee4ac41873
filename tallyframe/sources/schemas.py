"""Declared schemas of the input tables: the columns the feature recipes use."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**kinds: str) -> T.StructType:
    # Day offsets are whole in principle and written with a fraction (-153.0) in places.
    types = {
        "id": T.LongType(),
        "int": T.IntegerType(),
        "num": T.DoubleType(),
        "day": T.DoubleType(),
        "str": T.StringType(),
    }
    return T.StructType(
        [
            T.StructField(name, types[kind], True)
            for kind, names in kinds.items()
            for name in names.split()
        ]
    )


# Column names of the input data.
CARD_MEASURES = """
    AMT_BALANCE AMT_CREDIT_LIMIT_ACTUAL AMT_DRAWINGS_ATM_CURRENT AMT_DRAWINGS_CURRENT
    AMT_DRAWINGS_OTHER_CURRENT AMT_DRAWINGS_POS_CURRENT AMT_INST_MIN_REGULARITY AMT_PAYMENT_CURRENT
    AMT_PAYMENT_TOTAL_CURRENT AMT_RECEIVABLE_PRINCIPAL AMT_RECIVABLE AMT_TOTAL_RECEIVABLE
    CNT_DRAWINGS_ATM_CURRENT CNT_DRAWINGS_CURRENT CNT_DRAWINGS_OTHER_CURRENT
    CNT_DRAWINGS_POS_CURRENT SK_DPD SK_DPD_DEF
""".split()

PREVIOUS_CATEGORIES = """
    NAME_CONTRACT_TYPE NAME_CASH_LOAN_PURPOSE NAME_CONTRACT_STATUS NAME_PAYMENT_TYPE NAME_PORTFOLIO
    NAME_PRODUCT_TYPE NAME_SELLER_INDUSTRY NAME_YIELD_GROUP PRODUCT_COMBINATION
""".split()

SUBJECT_CATEGORIES = """
    NAME_CONTRACT_TYPE CODE_GENDER NAME_TYPE_SUITE NAME_INCOME_TYPE NAME_EDUCATION_TYPE
    NAME_FAMILY_STATUS NAME_HOUSING_TYPE OCCUPATION_TYPE
""".split()

SUBJECT_FLAGS = """
    FLAG_MOBIL FLAG_EMP_PHONE FLAG_WORK_PHONE FLAG_CONT_MOBILE FLAG_PHONE FLAG_EMAIL
""".split()

TABLES: dict[str, T.StructType] = {
    "monthly_status": _schema(id="SK_ID_BUREAU", int="MONTHS_BALANCE", str="STATUS"),
    "external_loans": _schema(
        id="SK_ID_CURR SK_ID_BUREAU",
        str="CREDIT_ACTIVE CREDIT_CURRENCY CREDIT_TYPE",
        num="""AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT AMT_CREDIT_SUM_OVERDUE
               AMT_CREDIT_MAX_OVERDUE AMT_ANNUITY""",
        int="CREDIT_DAY_OVERDUE CNT_CREDIT_PROLONG",
        day="DAYS_CREDIT DAYS_CREDIT_ENDDATE DAYS_ENDDATE_FACT DAYS_CREDIT_UPDATE",
    ),
    "pos_snapshots": _schema(
        id="SK_ID_PREV SK_ID_CURR",
        int="MONTHS_BALANCE SK_DPD SK_DPD_DEF",
        str="NAME_CONTRACT_STATUS",
        num="CNT_INSTALMENT CNT_INSTALMENT_FUTURE",
    ),
    "instalment_payments": _schema(
        id="SK_ID_CURR SK_ID_PREV",
        num="NUM_INSTALMENT_NUMBER NUM_INSTALMENT_VERSION AMT_INSTALMENT AMT_PAYMENT",
        day="DAYS_INSTALMENT DAYS_ENTRY_PAYMENT",
    ),
    "card_snapshots": _schema(
        id="SK_ID_PREV SK_ID_CURR",
        int="MONTHS_BALANCE SK_DPD SK_DPD_DEF",
        str="NAME_CONTRACT_STATUS",
        num=" ".join(m for m in CARD_MEASURES if not m.startswith("SK_")),
    ),
    "previous_applications": _schema(
        id="SK_ID_CURR SK_ID_PREV",
        str=" ".join(PREVIOUS_CATEGORIES),
        num="AMT_APPLICATION AMT_CREDIT AMT_ANNUITY AMT_DOWN_PAYMENT AMT_GOODS_PRICE",
        day="""DAYS_DECISION DAYS_FIRST_DRAWING DAYS_FIRST_DUE DAYS_LAST_DUE_1ST_VERSION DAYS_LAST_DUE
               DAYS_TERMINATION""",
    ),
    "subject_test": _schema(
        id="SK_ID_CURR",
        str=" ".join([*SUBJECT_CATEGORIES, "FONDKAPREMONT_MODE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]),
        num="""AMT_INCOME_TOTAL AMT_CREDIT AMT_ANNUITY AMT_GOODS_PRICE CNT_CHILDREN CNT_FAM_MEMBERS
               EXT_SOURCE_1 EXT_SOURCE_2 EXT_SOURCE_3""",
        int=" ".join([*SUBJECT_FLAGS, *[f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]]),
        day="DAYS_BIRTH DAYS_EMPLOYED DAYS_REGISTRATION DAYS_ID_PUBLISH DAYS_LAST_PHONE_CHANGE",
    ),
    "data_dictionary": _schema(str="Table Row Description"),
}
TABLES["subject_train"] = T.StructType(
    [T.StructField("TARGET", T.IntegerType(), True), *TABLES["subject_test"].fields]
)
