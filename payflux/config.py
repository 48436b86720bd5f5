"""Parameters of preprocessing, model, training and anomaly ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The input's columns in the order of their positions.
COLUMNS = (
    "uetr", "payment_channel", "debit_bic_code", "bene_bic_code", "evt_tran_stat_cde", "instructed_currency", "instructed_amount",
    "payment_currency", "payment_amount", "credit_currency", "credit_amount", "txn_dt", "tds_dt", "mop", "debit_account_masked", "bene_account_masked",
)


@dataclass(frozen=True)
class ColumnMap:
    """Which column plays which part."""

    source: str = "debit_account_masked"
    destination: str = "bene_account_masked"
    numeric: tuple[str, ...] = ("instructed_amount", "payment_amount", "credit_amount")
    categorical: tuple[str, ...] = ("payment_channel", "debit_bic_code", "bene_bic_code", "instructed_currency", "payment_currency", "credit_currency", "mop")
    event_time: str = "txn_dt"
    storage_time: str = "tds_dt"
    amounts: tuple[str, ...] = ("instructed_amount", "payment_amount", "credit_amount")
    distributions: tuple[str, ...] = ("payment_channel", "instructed_currency", "mop")


@dataclass(frozen=True)
class PreprocessConfig:
    columns: ColumnMap = field(default_factory=ColumnMap)
    output_dir: str = "./processed_data"
    embedding_dim: int = 8
    #: The first rows only, in the order of edge ids; None: all.
    limit_rows: int | None = None
    unknown: str = "UNKNOWN"
    #: What a missing account becomes; None drops the transaction.
    missing_account: str | None = "nan"
    event_formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd")
    storage_formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "dd/MM/yyyy HH:mm")
    #: Category features as vectors drawn from hashes, or as codes.
    encode_categories: str = "embedding"


@dataclass(frozen=True)
class ModelConfig:
    encoder_type: str = "gat"
    decoder_type: str = "gat"
    hidden_channels: int = 256
    out_channels: int = 128
    num_layers: int = 2
    num_heads: int = 4
    negative_slope: float = 0.2
    #: Of states before each layer, and of attention; only while training.
    dropout: float = 0.2
    attn_drop: float = 0.1
    mask_rate: float = 0.5
    replace_rate: float = 0.1
    drop_edge_rate: float = 0.0
    residual: bool = False
    #: Whether all encoder layers' states go to the decoder.
    concat_hidden: bool = False
    norm: str | None = None
    activation: str = "prelu"
    loss_fn: str = "sce"
    alpha: float = 2.0


@dataclass(frozen=True)
class ParameterGroup:
    """Weights whose names (step.name, as in 0.w) match: a factor of their rate, and their decay (None: as others)."""

    names: str
    rate: float = 1.0
    weight_decay: float | None = None


@dataclass(frozen=True)
class TrainConfig:
    epochs: int = 500
    learning_rate: float = 1e-3
    weight_decay: float = 1e-5
    optimizer: str = "adam"
    patience: int = 20
    grad_clip: float = 1.0
    groups: tuple[ParameterGroup, ...] = ()


@dataclass(frozen=True)
class AnomalyConfig:
    edge_score_strategy: str = "max"
    #: error: of unmasked nodes; sampled: the mean over num_samples maskings.
    node_scores: str = "error"
    num_samples: int = 10
    threshold_percentile: float = 95.0
    top_k_values: tuple[int, ...] = (10, 20, 50, 100, 200, 500)


@dataclass(frozen=True)
class MainConfig:
    model: ModelConfig = field(default_factory=ModelConfig)
    train: TrainConfig = field(default_factory=TrainConfig)
    anomaly: AnomalyConfig = field(default_factory=AnomalyConfig)
    preprocessed_dir: str = "./processed_data"
    output_dir: str = "./output"
    #: Where training keeps its last epochs and goes on from; None: nowhere.
    checkpoints: str | None = None
    seed: int = 42
