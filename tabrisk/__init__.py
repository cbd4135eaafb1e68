"""tabrisk — Spark-native tabular risk modelling.

Profiling, cleaning, encoding, correlation-driven selection, exact kNN
imputation, z-scoring, stratified and diversity-aware sampling, SMOTE,
random-forest cross-validation with exact metrics, tree SHAP attributions and
report prompts, all as DataFrame operators.
"""

__version__ = "0.1.0"
