"""Display names, code labels, unit formats and prompt texts.

The clinical set below is the one of the original stroke-risk report and must
stay as written for identical report text.  The ``SUBJECT_*`` set is this
repository's own, for the customer stand-in table used by tests and queries.
"""

# ---------------------------------------------------------------- fixed values
# Clinical schema: feature -> display name, in source column order.
CLINICAL_DISPLAY_NAMES = {
    "gender": "Sex",
    "age": "Age",
    "hypertension": "High Blood Pressure",
    "heart_disease": "Cardiovascular Disease History",
    "ever_married": "Marital History",
    "work_type": "Occupation Type",
    "Residence_type": "Living Environment",
    "avg_glucose_level": "Average Glucose Level",
    "bmi": "Body Mass Index (BMI)",
    "smoking_status": "Smoking History",
}

# Clinical schema: code -> label per categorical feature.
CLINICAL_VALUE_LABELS = {
    "gender": {0: "Female", 1: "Male"},
    "hypertension": {0: "Absent", 1: "Present"},
    "heart_disease": {0: "Absent", 1: "Present"},
    "ever_married": {0: "No", 1: "Yes"},
    "work_type": {0: "Government Job", 1: "Never Worked", 2: "Private", 3: "Self-employed", 4: "Children"},
    "Residence_type": {0: "Rural", 1: "Urban"},
    "smoking_status": {0: "Unknown", 1: "Formerly Smoked", 2: "Never Smoked", 3: "Smokes"},
}

# Clinical schema: numeric display rules (one decimal with unit, or whole number).
CLINICAL_RULES = {
    "bmi": ("fixed1", " kg/m²"),
    "avg_glucose_level": ("fixed1", " mg/dL"),
    "age": ("int", " years"),
}

CLINICAL_CATEGORICAL = ["gender", "ever_married", "work_type", "Residence_type", "smoking_status"]
CLINICAL_NUMERIC = ["age", "avg_glucose_level", "bmi"]
CLINICAL_RAW_COLUMNS = ["id", "gender", "age", "hypertension", "heart_disease", "ever_married",
                        "work_type", "Residence_type", "avg_glucose_level", "bmi", "smoking_status",
                        "stroke"]
STATUS_LABELS = ("No Risk", "Risk")
DECISION_THRESHOLD = 0.1

SYSTEM_PROMPT = (
    "You are a clinical summarisation assistant specialised in stroke risk assessment. "
    "You MUST follow the exact format shown in the examples. "
    "Generate concise, clinician-friendly, medically accurate explanations using the top 3 features only. "
    "For EACH feature, write 1-2 sentences explaining its medical relevance and impact in natural, clinically accepted terms. "
    "Avoid casual or incorrect labels. For example, when describing BMI, apply standard classification thresholds (e.g., overweight for 25.0–29.9, obesity for ≥30). "
    "End with an Overall Summary sentence aligned with the predicted stroke risk status. "
    "Do not provide recommendations, treatments, management advice, lifestyle changes, monitoring suggestions, or next steps."
)

# User prompt; {top_feature_list}, {risk_label} and {patient_feature_block}
# are filled per row.  Three lines end with a space, as in the original.
USER_PROMPT_TEMPLATE = """
Use the exact reasoning style and structure demonstrated in the examples below. 

Example 1:

Predicted Stroke Status: Risk
Patient Data:
Sex: Male
Age: 68 years
High Blood Pressure: Present
Cardiovascular Disease History: Absent
Marital History: Yes
Occupation Type: Private
Living Environment: Urban
Average Glucose Level: 120.5 mg/dL
Body Mass Index (BMI): 27.5 kg/m²
Smoking History: Formerly Smoked

Explanation:

The input features that had the greatest impact on the stroke risk prediction were Age, High Blood Pressure, and Smoking History.

Age: Advanced age increases stroke risk due to vascular aging including arterial stiffening and plaque buildup. At 68, this patient's stroke risk is significantly elevated.

High Blood Pressure: High blood pressure causes vascular wall damage and accelerates atherosclerosis, raising stroke probability.

Smoking History: Former smoking contributes to vascular inflammation and endothelial dysfunction, increasing risk.

Overall Summary: The combination of age, high blood pressure, and smoking history contribute to stroke risk.


Example 2:

Predicted Stroke Status: No Risk
Patient Data:
Sex: Female
Age: 42 years
High Blood Pressure: Absent
Cardiovascular Disease History: Absent
Marital History: Yes
Occupation Type: Self-employed
Living Environment: Urban
Average Glucose Level: 88.4 mg/dL
Body Mass Index (BMI): 22.7 kg/m²
Smoking History: Never Smoked

Explanation:

The input features that had the greatest impact on the stroke risk prediction were Age, High Blood Pressure, and Smoking History.

Age: At 42, the patient's vascular age is low, with reduced cumulative risk.

High Blood Pressure: Absence of high blood pressure removes one of the most significant drivers of cerebrovascular disease.

Smoking History: Never smoking avoids vascular toxins and inflammation.

Overall Summary: Youth, normal blood pressure, and no smoking history contribute to no stroke risk.

Now generate the stroke risk report for the following patient. 

CRITICAL: Your response MUST start with this exact sentence:
"The input features that had the greatest impact on the stroke risk prediction were {top_feature_list}."

Then, for EACH of the three features, write its name as a heading followed by 1-2 sentences explaining how it medically impacts this patient's stroke risk.

Finally, end with "Overall Summary:" followed by one sentence summarising the combined effect of these features. 
Do not include any advice or recommendations.

Predicted Stroke Status: {risk_label}

Patient Data:
{patient_feature_block}

Begin your explanation now:

"""

# Error text forms of the completion client.
COMPLETION_ERROR_PREFIX = "Error generating completion: "
COMPLETION_METADATA_ERROR_PREFIX = "Error: "
# ------------------------------------------------------------ end fixed values

# This repository's stand-in table (customers); not reference values.
SUBJECT_DISPLAY_NAMES = {
    "segment": "Market Segment",
    "top_priority": "Top Order Priority",
    "many_orders": "Frequent Buyer",
    "n_orders": "Order Count",
    "avg_price": "Average Order Value",
    "max_price": "Largest Order Value",
}
SUBJECT_VALUE_LABELS = {"many_orders": {0: "No", 1: "Yes"}}
SUBJECT_RULES = {
    "n_orders": ("int", " orders"),
    "avg_price": ("fixed1", " USD"),
    "max_price": ("fixed1", " USD"),
}
