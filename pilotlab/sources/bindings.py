"""Column and value names of the bank's own tables, mapped to the names used in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Table names.
TABLE_NAMES = {
    "client": "clientes",
    "card": "tarjetas",
    "tx": "transacciones",
    "contact": "interacciones_marketing",
    "merchant": "catalogo_comercios",
}

# Column names per table, source name to package name.
COLUMN_NAMES = {
    "client": {
        "cliente_id": "client_id",
        "cedula": "national_id",
        "fecha_nacimiento": "birth_ts",
        "fecha_registro": "registered_ts",
        "ciudad": "city",
        "canal_adquisicion": "acquisition_channel",
        "estado_cuenta": "account_status",
        "flag_menor_edad_al_registro": "flag_minor",
        "flag_cedula_invalida": "flag_invalid_id",
        "fecha_nacimiento_fuera_rango": "birth_ts_out_of_range",
        "fecha_registro_fuera_rango": "registered_ts_out_of_range",
    },
    "card": {
        "cliente_id": "client_id",
        "tipo": "card_type",
        "estado_codigo": "status_code",
        "fecha_emision": "issued_ts",
        "fecha_activacion": "activated_ts",
        "flag_activacion_antes_emision": "flag_activation_order",
        "fecha_emision_fuera_rango": "issued_ts_out_of_range",
        "fecha_activacion_fuera_rango": "activated_ts_out_of_range",
        "flag_cliente_id_huerfano": "flag_orphan_client",
    },
    "tx": {
        "transaccion_id": "tx_id",
        "cliente_id": "client_id",
        "fecha": "ts",
        "tipo_transaccion": "tx_type",
        "monto": "amount",
        "comercio_codigo": "merchant_code",
        "es_devolucion": "is_refund",
        "flag_cliente_id_huerfano": "flag_orphan_client",
        "flag_fecha_futura": "flag_future",
        "flag_comercio_codigo_huerfano": "flag_orphan_merchant",
        "fecha_fuera_rango": "ts_out_of_range",
    },
    "contact": {
        "cliente_id": "client_id",
        "fecha_contacto": "contacted_ts",
        "campana": "campaign",
        "canal": "channel",
        "respondio": "responded",
        "flag_fecha_contacto_futura": "flag_future",
        "fecha_contacto_fuera_rango": "contacted_ts_out_of_range",
        "flag_cliente_id_huerfano": "flag_orphan_client",
    },
    "merchant": {"comercio_codigo": "merchant_code", "categoria": "category"},
    "effect_base": {
        "cliente_id": "client_id",
        "T": "treated",
        "t0": "t0",
        "Y_frecuencia": "y_frequency",
        "Y_monto": "y_amount",
        "edad": "age_years",
        "ciudad": "city",
        "canal_adquisicion": "acquisition_channel",
        "antiguedad_cliente": "tenure_days",
        "frecuencia_pre": "frequency_pre",
        "monto_pre": "amount_pre",
        "diversidad_tipo_pre": "type_diversity_pre",
        "uso_cash_in_out_pre": "cash_share_pre",
        "n_contactos_marketing": "n_contacts",
        "tasa_respuesta_marketing": "response_rate",
        "tiene_virtual_activa": "has_active_virtual",
        "antiguedad_tarjeta_virtual": "virtual_card_days",
        "cedula_valida": "id_valid",
    },
    "segment_base": {
        "cliente_id": "client_id",
        "edad": "age_years",
        "antiguedad_cliente": "tenure_days",
        "frecuencia_mensual": "monthly_frequency",
        "monto_mensual": "monthly_amount",
        "diversidad_tipo": "type_diversity",
        "contactos_mensuales": "monthly_contacts",
        "tasa_respuesta": "response_rate",
        "tiene_virtual_activa": "has_active_virtual",
        "antiguedad_tarjeta_virtual": "virtual_card_days",
        "ciudad": "city",
        "canal_adquisicion": "acquisition_channel",
        "cluster_id": "cluster_id",
        "segmento_prioridad": "segment",
        "puntaje_prioridad_individual": "priority_score",
    },
}

# Labels of cleaned data.
CARD_PREFIXES = {"f": "fisica", "v": "virtual"}
PHYSICAL, VIRTUAL = "fisica", "virtual"
CASH_TYPES = ("cash in", "cash out")
PILOT_CAMPAIGN = "piloto tarjeta fisica q2"
MISSING_CATEGORY = "desconocido"


def to_package_names(df: DataFrame, table: str) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in COLUMN_NAMES[table].items() if k in df.columns})


def to_source_names(df: DataFrame, table: str) -> DataFrame:
    names = {v: k for k, v in COLUMN_NAMES[table].items()}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
