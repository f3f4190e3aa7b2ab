"""Fixed values of the discharge domain.

Word lists, lookup tables and constants that must be exactly these for results to be right.
Nothing here is logic.
"""

# Column groups of the 33-column discharge table, in raw file order per group.
RAW_COLUMNS = (
    "Hospital Service Area", "Hospital County", "Operating Certificate Number",
    "Permanent Facility Id", "Facility Name", "Age Group", "Zip Code - 3 digits", "Gender",
    "Race", "Ethnicity", "Length of Stay", "Type of Admission", "Patient Disposition",
    "Discharge Year", "CCSR Diagnosis Code", "CCSR Diagnosis Description",
    "CCSR Procedure Code", "CCSR Procedure Description", "APR DRG Code",
    "APR DRG Description", "APR MDC Code", "APR MDC Description",
    "APR Severity of Illness Code", "APR Severity of Illness Description",
    "APR Risk of Mortality", "APR Medical Surgical Description", "Payment Typology 1",
    "Payment Typology 2", "Payment Typology 3", "Birth Weight",
    "Emergency Department Indicator", "Total Charges", "Total Costs",
)
TEXT_COLUMNS = (
    "hospital_service_area", "hospital_county", "facility_name", "age_group", "race",
    "ethnicity", "type_of_admission", "patient_disposition", "ccsr_diagnosis_description",
    "ccsr_procedure_description", "apr_drg_description", "apr_mdc_description",
    "apr_severity_of_illness_description", "apr_risk_of_mortality",
    "apr_medical_surgical_description",
)
CODE_COLUMNS = (
    "operating_certificate_number", "permanent_facility_id", "zip_code_3_digits",
    "ccsr_diagnosis_code", "ccsr_procedure_code", "apr_drg_code", "apr_mdc_code",
)
PAYMENT_COLUMNS = ("payment_typology_1", "payment_typology_2", "payment_typology_3")
INT_COLUMNS = (
    "length_of_stay", "discharge_year", "apr_severity_of_illness_code", "birth_weight",
)
MONEY_COLUMNS = ("total_charges", "total_costs")

# Gender spellings and the emergency flag's domain.
GENDER_MAP = {
    "m": "Male",
    "f": "Female",
    "u": "Unknown",
    "male": "Male",
    "female": "Female",
    "unknown": "Unknown",
}
YES_NO = ("Y", "N")

# Columns whose value distribution goes into the quality report / overview.
REPORT_FIELDS = (
    "gender", "payment_typology_1", "age_group", "type_of_admission",
    "emergency_department_indicator",
)
OVERVIEW_FIELDS = (
    "age_group", "gender", "type_of_admission", "payment_typology_1",
    "ccsr_diagnosis_description", "hospital_county",
)

# Fields that association rules may use.
RULE_FIELDS = (
    "ccsr_diagnosis_description", "ccsr_diagnosis_code", "ccsr_procedure_description",
    "ccsr_procedure_code", "apr_mdc_description", "apr_severity_of_illness_description",
    "type_of_admission", "payment_typology_1", "age_group",
)

# The metrics as (key, aggregate, column, decimals, unit).
METRICS = (
    ("discharge_count", "count", None, 0, "discharges"),
    ("avg_length_of_stay", "avg", "length_of_stay", 1, "days"),
    ("max_length_of_stay", "max", "length_of_stay", 0, "days"),
    ("avg_total_charges", "avg", "total_charges", 2, "USD"),
    ("sum_total_charges", "sum", "total_charges", 2, "USD"),
    ("avg_total_costs", "avg", "total_costs", 2, "USD"),
    ("sum_total_costs", "sum", "total_costs", 2, "USD"),
    ("avg_birth_weight", "avg", "birth_weight", 0, "g"),
    ("avg_severity_of_illness", "avg", "apr_severity_of_illness_code", 2, "level"),
)

# Points of the readmission risk score and its levels.
AGE_POINTS = {"70 or Older": 25, "50 to 69": 10}
ADMISSION_POINTS = {"Emergency": 20}
SEVERITY_POINTS = {"Extreme": 25, "Major": 15, "Moderate": 5}
MORTALITY_POINTS = {"Extreme": 15, "Major": 10}
LONG_STAY_DAYS, LONG_STAY_POINTS = 10, 10
HOME_DISPOSITIONS, NOT_HOME_POINTS = ("Home or Self Care",), 5
HIGH_FROM, MEDIUM_FROM = 60.0, 30.0

# Words that name a dimension.
DIMENSION_WORDS = {
    "discharge_year": ["年份", "年度", "year", "哪年", "哪一年", "2021", "2022"],
    "age_group": ["年龄", "年龄段", "年纪", "老人", "儿童", "小孩", "老年", "中年", "青年",
                  "少年", "age", "岁"],
    "gender": ["性别", "男女", "男", "女", "gender", "sex"],
    "race": ["种族", "race"],
    "ethnicity": ["族裔", "民族", "西班牙裔", "hispanic"],
    "zip_code_3_digits": ["邮编", "邮政编码", "zip", "zipcode"],
    "hospital_service_area": ["服务区域", "区域", "service area"],
    "hospital_county": ["县", "医院县", "所在县", "county"],
    "facility_name": ["医院", "机构", "医疗机构", "facility", "hospital"],
    "ccsr_diagnosis_description": ["疾病", "病种", "诊断", "什么病", "disease", "diagnosis"],
    "ccsr_procedure_description": ["操作", "手术", "procedure", "治疗方式"],
    "apr_drg_description": ["DRG", "drg", "病组"],
    "apr_mdc_description": ["MDC", "mdc", "大类"],
    "apr_severity_of_illness_description": ["病情", "严重程度", "severity", "严重度"],
    "apr_risk_of_mortality": ["死亡风险", "mortality", "死亡率"],
    "apr_medical_surgical_description": ["内外科", "medical", "surgical", "外科", "内科"],
    "type_of_admission": ["入院类型", "入院方式", "急诊入院", "择期", "admission", "急诊",
                          "elective"],
    "patient_disposition": ["出院去向", "出院", "disposition", "去向"],
    "emergency_department_indicator": ["急诊", "急诊科", "emergency", "ed"],
    "payment_typology_1": ["支付方式", "支付", "医保", "payment", "medicare", "medicaid"],
}

# Words that stand for one value of a dimension.
VALUE_WORDS = {
    "age_group": {
        "0 to 17": ["儿童", "小孩", "未成年", "婴幼儿", "婴儿", "pediatric", "child", "kid"],
        "18 to 29": ["青年", "年轻人", "18-29", "young"],
        "30 to 49": ["中年", "中年人", "30-49", "middle"],
        "50 to 69": ["中老年", "50-69", "50-69岁"],
        "70 or Older": ["老年", "老年人", "高龄", "70以上", "70+", "elderly", "old"],
    },
    "gender": {
        "Male": ["男", "男性", "male", "m"],
        "Female": ["女", "女性", "female", "f"],
        "Unknown": ["未知", "不详", "unknown"],
    },
    "type_of_admission": {
        "Emergency": ["急诊", "急诊入院", "emergency"],
        "Elective": ["择期", "择期入院", "elective"],
        "Urgent": ["紧急", "urgent"],
        "Newborn": ["新生儿", "newborn"],
        "Trauma": ["外伤", "创伤", "trauma"],
    },
    "apr_severity_of_illness_description": {
        "Minor": ["轻微", "轻症", "minor"],
        "Moderate": ["中度", "中等", "moderate"],
        "Major": ["重度", "major"],
        "Extreme": ["极重", "危重", "extreme", "critical"],
    },
    "apr_risk_of_mortality": {
        "Minor": ["死亡风险低", "minor"],
        "Moderate": ["死亡风险中", "moderate"],
        "Major": ["死亡风险高", "major"],
        "Extreme": ["死亡风险极高", "extreme"],
    },
    "apr_medical_surgical_description": {
        "Medical": ["内科", "medical"],
        "Surgical": ["外科", "surgical", "手术"],
    },
    "payment_typology_1": {
        "Medicare": ["medicare", "联邦医保"],
        "Medicaid": ["medicaid", "州医保"],
        "Private Health Insurance": ["商业保险", "私人保险", "private"],
        "Self-Pay": ["自费", "self-pay"],
        "Department of Corrections": ["矫正部门", "corrections"],
        "Government": ["政府", "government"],
    },
    "emergency_department_indicator": {
        "Y": ["急诊", "是急诊", "ed就诊", "y"],
        "N": ["非急诊", "n"],
    },
}

# Words that name a metric.
METRIC_WORDS = {
    "discharge_count": ["人次", "人数", "多少", "几条", "count"],
    "avg_length_of_stay": ["平均住院", "平均住院时长", "平均住院天数", "住院时长"],
    "max_length_of_stay": ["最长住院", "最长住院时长"],
    "avg_total_charges": ["平均费用", "平均花费", "平均总费用"],
    "sum_total_charges": ["总费用", "总花费", "费用合计", "费用总和"],
    "avg_total_costs": ["平均成本", "平均总成本"],
    "sum_total_costs": ["总成本", "成本合计"],
    "avg_birth_weight": ["平均出生体重", "出生体重"],
    "avg_severity_of_illness": ["平均严重度", "平均病情"],
}

# Words that point to an analysis.
ANALYSIS_WORDS = {
    "statistics": ["整体", "总览", "概览", "概要", "总体", "全平台", "全部", "总统计",
                   "整体情况", "总体情况", "数据总览", "整体统计"],
    "association": ["关联", "伴生", "伴随", "经常一起", "同时出现", "common", "associated",
                    "经常和", "经常伴随", "和...一起"],
    "cost_prediction": ["预测费用", "预测花费", "费用预测", "预估费用", "预估花费", "花费预测",
                        "predict", "预测住院费用", "预估住院费用", "预测住院花费",
                        "预估住院花费"],
    "readmission_risk": ["再入院", "再住院", "readmission", "再入院风险", "再住院风险"],
}
METADATA_WORDS = [
    "哪些维度", "哪些指标", "支持什么", "能做什么", "可用算法", "有什么算法", "维度清单",
    "指标清单", "算法清单", "有哪些维度", "有哪些指标", "有哪些算法", "能查询什么", "能干什么",
    "能分析什么", "可用能力", "可用分析能力", "支持哪些", "支持什么分析",
]
OVERVIEW_WORDS = [
    "整体", "总览", "概览", "总体", "概况", "总统计", "数据总览", "核心指标", "整体情况",
    "总体情况", "整体统计", "整体概况",
]
OFF_TOPIC_WORDS = [
    "天气", "机票", "订票", "火车票", "笑话", "故事", "翻译", "减肥", "炒股票", "股票",
    "推荐书", "推荐电影", "你是谁", "你是", "今天几号", "几点", "北京有什么", "景点", "旅游",
    "美食",
]
PREDICT_VERBS = ["预测", "预估", "估计", "predict"]
COST_NOUNS = ["费用", "花费", "cost"]
READMISSION_NOUNS = ["再入院", "再住院"]
COUNTING_WORD = "统计"

# Patterns of the text layer.
GROUPED_COUNT_PATTERN = r"按.{0,8}统计|按.{0,8}分组|各.{0,4}的|每个.{0,4}的|分别.{0,4}"
GROUPING_PATTERN = r"按|各|每个|不同|分别|分组"
PLAIN_GROUPING_PATTERN = r"按|各|每个|分别|分组"
DISEASE_PATTERN = r"病|诊断|肺炎"
TREATMENT_PATTERN = r"操作|手术|治疗|伴生|伴随"
YEAR_PATTERN = r"20[12]\d|199\d"
DAYS_PATTERN = r"(\d+)\s*天"
TOP_N_PATTERN = r"(?:top|前)\s*(\d+)"

# Weights and thresholds of the intent scores.
INTENTS = (
    "metadata_query", "statistics_overview", "association_analysis", "cost_prediction",
    "readmission_risk", "aggregation_query",
)
UNSUPPORTED = "unsupported"
MIN_CONFIDENCE = 0.45
CONFIDENCE_OFF_TOPIC, CONFIDENCE_NO_SIGNAL, CONFIDENCE_EMPTY = 0.95, 0.4, 0.0
BONUS_METADATA, BONUS_OVERVIEW, BONUS_COUNTING = 0.4, 0.4, 0.2
BONUS_ASSOCIATION, BONUS_PREDICTION, BONUS_READMISSION = 0.3, 0.4, 0.3
VERB_AND_NOUN, DISEASE_AND_TREATMENT, READMISSION_ALONE = 0.85, 0.78, 0.85
PER_DIMENSION, DIMENSIONS_CAP = 0.25, 0.6
PER_METRIC, METRICS_CAP = 0.15, 0.4
GROUPING_BONUS, GROUPED_OVERVIEW_FLOOR = 0.35, 0.85

# Numbers in text. A unit may follow; two of them multiply the number.
UNITS = ("万", "亿", "天", "例", "条", "人", "分", "秒", "%", "岁", "元", "美元")
MULTIPLIERS = {"万": 1e4, "亿": 1e8}
FIRST_YEAR, LAST_YEAR = 1900, 2099
CODE_LIKE_FROM = 1e9
