"""The lexicon of fields: which label of which kind of document says which variable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import text as T

# Kind of document; variable; type; evidence; labels, the first that is found counts. A star after the variable: it is a key of a unit.
FIELDS = """
ficha_cumplimentada; titular_razon_social; text; shown; propietario inicial del ahorro (titular) | titular
ficha_cumplimentada; titular_nif; code; shown; nif del titular
ficha_cumplimentada; fecha_inicio_actuacion; date; shown; fecha de inicio de la actuacion
ficha_cumplimentada; fecha_fin_actuacion; date; shown; fecha de fin de la actuacion
ficha_cumplimentada; n_motores; integer; shown; numero de motores incluidos
ficha_cumplimentada; num_serie_motor*; serial; shown; no de serie del motor
ficha_cumplimentada; num_serie_variador*; serial; shown; no de serie del variador
ficha_cumplimentada; PM; number; shown; potencia nominal del motor pm
ficha_cumplimentada; N1; number; shown; velocidad antes de la actuacion n1
ficha_cumplimentada; N2; number; declared; velocidad media con variador n2 (declarada)
ficha_cumplimentada; P_prom; number; declared; potencia promedio con variador p_prom (declarada)
ficha_cumplimentada; h_antes; number; shown; horas anuales de funcionamiento previas
declaracion_responsable; titular_razon_social; text; shown; razon social del titular
declaracion_responsable; titular_nif; code; shown; nif del titular
factura; titular_razon_social; text; shown; receptor (cliente) | receptor
factura; titular_nif; code; shown; nif del receptor
factura; fecha_inicio_actuacion; date; shown; fecha de factura | fecha de pedido
factura; n_motores; integer; shown; no de variadores facturados | numero de motores
informe_fotografico; num_serie_motor*; serial; shown; no de serie del motor
informe_fotografico; num_serie_variador*; serial; shown; no de serie del variador instalado | no de serie del variador
informe_fotografico; n_motores; integer; shown; numero de motores fotografiados
certificado_instalador; titular_razon_social; text; shown; titular de la instalacion
certificado_instalador; titular_nif; code; shown; nif del titular
certificado_instalador; fecha_fin_actuacion; date; shown; fecha de puesta en marcha (fin de la actuacion)
certificado_instalador; n_motores; integer; shown; numero de motores intervenidos
certificado_instalador; num_serie_motor*; serial; shown; no de serie del motor
certificado_instalador; num_serie_variador*; serial; shown; no de serie del variador
certificado_instalador; PM; number; shown; a) potencia nominal del motor pm (segun ficha tecnica)
certificado_instalador; N1; number; shown; a) velocidad nominal n1 (segun ficha tecnica)
certificado_instalador; P_prom; number; declared; b) potencia promedio con variador p_prom
certificado_instalador; N2; number; declared; b) velocidad media con variador n2
certificado_instalador; registro.hash_declarado; hash; declared; b) sha-256 del registro | sha-256 del registro
registro_horas_previo; num_serie_motor*; serial; shown; no de serie del motor
registro_horas_previo; h_antes; number; shown; horas anuales de funcionamiento (h_antes) | horas anuales de funcionamiento
ficha_tecnica_motor; num_serie_motor*; serial; shown; no de serie del motor
ficha_tecnica_motor; PM; number; shown; potencia nominal pm | potencia nominal
ficha_tecnica_motor; N1; number; shown; velocidad nominal n1 | velocidad nominal
ficha_tecnica_variador; num_serie_variador*; serial; shown; no de serie del variador
ficha_tecnica_variador; perdidas_declaradas_variador; number; declared; perdidas declaradas por el fabricante | perdidas declaradas
convenio_cae; titular_razon_social; text; shown; propietario inicial del ahorro (razon social) | propietario inicial del ahorro
convenio_cae; titular_nif; code; shown; nif del propietario inicial
convenio_cae; convenio.ahorro_kwh; integer; declared; ahorro anual de energia final
convenio_cae; convenio.fecha_firma; date; shown; fecha de firma del convenio
pedido; titular_razon_social; text; shown; cliente | receptor
pedido; titular_nif; code; shown; nif del cliente
pedido; fecha_inicio_actuacion; date; shown; fecha de pedido
"""


def field_rows(text: str = FIELDS) -> list[tuple]:
    """(kind, label, variable, type, evidence, place, in_text, is_key) for each label."""
    out = []
    for line in text.strip().splitlines():
        kind, variable, type_, evidence, labels = (x.strip() for x in line.split(";"))
        for place, label in enumerate(x.strip() for x in labels.split(" | ")):
            out.append((kind, label, variable.rstrip("*"), type_, evidence, place, True, variable.endswith("*")))
    return out


def fields(spark: SparkSession, text: str = FIELDS) -> DataFrame:
    """The lexicon as a table, labels folded."""
    rows = spark.createDataFrame(field_rows(text), "kind string, label string, variable string, type string, evidence string, place int, in_text boolean, is_key boolean")
    return rows.withColumn("label", T.label_fold(F.col("label")))
