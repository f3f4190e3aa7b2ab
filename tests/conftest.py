import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from cohortlens.presets.discharge import SCHEMA  # noqa: E402
from cohortlens.session import with_settings  # noqa: E402

# The 600-row fixture, whose figures are known in closed form.
AGES = ["0 to 17", "18 to 29", "30 to 49", "50 to 69", "70 or Older"]
ADMISSIONS = ["Emergency", "Elective", "Urgent", "Newborn"]
LEVELS = ["Minor", "Moderate", "Major", "Extreme"]
COUNTIES = ["Bronx", "Kings", "Queens"]
PAYMENTS = ["Medicare", "Medicaid", "Private Health Insurance"]
N = 600


def discharge(i: int) -> dict:
    return {
        "hospital_service_area": "New York City",
        "hospital_county": COUNTIES[i % 3],
        "operating_certificate_number": f"OC{i:07d}",
        "permanent_facility_id": f"PF{i:06d}",
        "facility_name": f"FACILITY_{i % 8}",
        "age_group": AGES[i % 5],
        "zip_code_3_digits": str(100 + i % 30),
        "gender": "Female" if i % 2 else "Male",
        "race": "White",
        "ethnicity": "Not Span/Hispanic",
        "type_of_admission": ADMISSIONS[i % 4],
        "patient_disposition": "Home or Self Care" if i % 5 else "Expired",
        "ccsr_diagnosis_code": f"DX{i:03d}",
        "ccsr_diagnosis_description": f"DISEASE_{i % 6}",
        "ccsr_procedure_code": f"PR{i:03d}",
        "ccsr_procedure_description": "PROC_2" if i % 6 == 3 else f"PROC_{i % 3}",
        "apr_drg_code": f"{i % 100:03d}",
        "apr_drg_description": f"DRG_{i % 10}",
        "apr_mdc_code": f"{i % 25:02d}",
        "apr_mdc_description": f"MDC_{i % 20}",
        "apr_severity_of_illness_description": LEVELS[i % 4],
        "apr_risk_of_mortality": LEVELS[i % 4],
        "apr_medical_surgical_description": "Surgical" if i % 2 else "Medical",
        "payment_typology_1": PAYMENTS[i % 3],
        "payment_typology_2": "Unknown",
        "payment_typology_3": "Unknown",
        "emergency_department_indicator": "N" if i % 2 else "Y",
        "length_of_stay": i % 20 + 1,
        "discharge_year": 2021,
        "apr_severity_of_illness_code": i % 4,
        "birth_weight": None if i % 10 == 0 else 3000 + i,
        "total_charges": 1000.0 + 10 * i,
        "total_costs": 600.0 + 4 * i,
    }


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
    )
    session = with_settings(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    return [discharge(i) for i in range(N)]


@pytest.fixture(scope="session")
def df(spark, rows):
    data = [tuple(r[f.name] for f in SCHEMA) for r in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def strings(spark):
    def make(values):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")

    return make


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
