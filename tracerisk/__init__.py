"""Task-failure analytics on cluster scheduler traces, as Spark jobs."""

from tracerisk.operators.clean import clean_trace
from tracerisk.operators.experiments import (
    ablation_plot_data,
    compare_models,
    confusion_plot_data,
    improvement_summary,
    roc_plot_data,
    run_ablation_study,
    run_cross_validation,
)
from tracerisk.operators.features import (
    calculate_concurrency_density,
    calculate_execution_duration,
    calculate_machine_failure_rate,
    calculate_machine_failure_rate_before,
    calculate_priority_gap,
    calculate_priority_inversion,
    calculate_resource_overcommit,
    calculate_scheduling_delay,
)
from tracerisk.operators.labels import create_labels, label_distribution
from tracerisk.operators.metrics import evaluate_model, run_paired_ttest
from tracerisk.operators.models import (
    get_coefficients,
    get_feature_importance,
    predict,
    train_boosted_trees,
    train_logistic_regression,
    train_random_forest,
)
from tracerisk.operators.profile import get_missing_summary
from tracerisk.operators.split import prepare_data
from tracerisk.operators.trees import split_gains, tree_nodes
from tracerisk.plans.matrix import build_feature_matrix, feature_matrix
from tracerisk.plans.stages import prepare_tables, report_results
from tracerisk.schema import (
    ALL_FEATURES,
    COLUMNS,
    EVENT_TYPES,
    FAILURE_EVENTS,
    NORMAL_EVENTS,
    NOVEL_FEATURES,
    RAW_FEATURES,
    TERMINAL_EVENTS,
)
from tracerisk.sources import load_model, load_trace_parts, save_model
from tracerisk.sources.ledger import load_new_parts

__all__ = [
    "ALL_FEATURES",
    "COLUMNS",
    "EVENT_TYPES",
    "FAILURE_EVENTS",
    "NORMAL_EVENTS",
    "NOVEL_FEATURES",
    "RAW_FEATURES",
    "TERMINAL_EVENTS",
    "ablation_plot_data",
    "build_feature_matrix",
    "calculate_concurrency_density",
    "calculate_execution_duration",
    "calculate_machine_failure_rate",
    "calculate_machine_failure_rate_before",
    "calculate_priority_gap",
    "calculate_priority_inversion",
    "calculate_resource_overcommit",
    "calculate_scheduling_delay",
    "clean_trace",
    "compare_models",
    "confusion_plot_data",
    "create_labels",
    "evaluate_model",
    "feature_matrix",
    "get_coefficients",
    "get_feature_importance",
    "get_missing_summary",
    "improvement_summary",
    "label_distribution",
    "load_model",
    "load_new_parts",
    "load_trace_parts",
    "predict",
    "prepare_data",
    "prepare_tables",
    "report_results",
    "roc_plot_data",
    "run_ablation_study",
    "run_cross_validation",
    "run_paired_ttest",
    "save_model",
    "split_gains",
    "train_boosted_trees",
    "train_logistic_regression",
    "train_random_forest",
    "tree_nodes",
]
