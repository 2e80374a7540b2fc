"""Schemas of the target tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPANIES = """
    credit_code string, company_name string, status string, legal_person string,
    scale string, capital_wan decimal(20,2), capital_raw string, capital_currency string,
    capital_paid_wan decimal(20,2), established date, approved date,
    established_year smallint, company_age decimal(6,1), term_raw string,
    province string, city string, district string, street string, company_type string,
    industry_l1 string, industry_l2 string, industry_l3 string, industry_l4 string,
    insured_count bigint, insured_year string, former_name string, en_name string,
    tax_id string, reg_no string, org_code string, address string,
    address_report string, address_mail string, website string, registrar string,
    taxpayer_qual string, intro string, report_year string, scope string,
    has_mobile tinyint, has_landline tinyint, has_email tinyint, has_contact tinyint,
    mobile_count int, email_count int, fill_score smallint, src_group string,
    src_file string, loaded_at timestamp_ntz, lng double, lat double,
    geo_precision string, geocoded_at timestamp_ntz
"""
CONTACTS = """
    credit_code string, contact_type string, contact_value string, source string,
    company_name string, is_primary tinyint, collected_at date, loaded_at timestamp_ntz
"""
TAGS = """
    credit_code string, company_name string, chain_industries array<string>,
    chain_nodes array<string>, chain_positions string, relatedness string,
    honors array<string>, financing_raw string, tag_finance string, tag_fit string,
    lead_score smallint, score_reach smallint, score_attract smallint,
    score_fit smallint, score_pay smallint, loaded_at timestamp_ntz
"""
QUALIFICATIONS = """
    credit_code string, qual_type string, cert_no string, company_name string,
    cert_year string, issue_date date, valid_to date, revoked tinyint,
    batch_no string, source string, loaded_at timestamp_ntz
"""
DIVISIONS = """
    row_key string, adcode string, level string, name string, parent_adcode string,
    province string, city string, district string, street string,
    center_lng double, center_lat double, source string, loaded_at timestamp_ntz
"""
CONTACT_STATUS = """
    credit_code string, user_id string, status string, note string,
    updated_at timestamp_ntz
"""
TERRITORY = """
    user_id string, province string, city string, district string, street string,
    loaded_at timestamp_ntz
"""

CONTACT_KEY = ["credit_code", "contact_type", "contact_value"]
CERTIFICATE_KEY = ["credit_code", "qual_type", "cert_no"]
TERRITORY_KEY = ["user_id", "province", "city", "district", "street"]


@dataclass(frozen=True)
class Tables:
    """The tables a query may need; unused ones stay None."""

    companies: DataFrame
    contacts: DataFrame | None = None
    tags: DataFrame | None = None
    qualifications: DataFrame | None = None
    divisions: DataFrame | None = None
    contact_status: DataFrame | None = None
    territory: DataFrame | None = None


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, in order and type; absent ones become NULL."""
    from pyspark.sql.types import StructType

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(ddl)
        ]
    )
