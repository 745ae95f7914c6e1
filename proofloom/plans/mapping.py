"""The mapping of a case to a handed-over document, and the query that applies it."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.operators import export as X
from proofloom.plans.registry import query

c, lit = F.col, F.lit

# Target; source; whether it must be there.
CASE = """
codigo_identificativo_propio; codigo_identificativo_propio; required
ficha; ficha.codigo; required
version_ficha; ficha.version_ficha; required
version_spec; ficha.version_spec; required
hash_spec; ficha.hash_spec; required
modelo_version; modelo_version; required
fecha_creacion; creado_en; optional
titular_nif; variables_actuacion.titular_nif.valor_consumido; required
titular_razon_social; variables_actuacion.titular_razon_social.valor_consumido; required
fecha_inicio_actuacion; variables_actuacion.fecha_inicio_actuacion.valor_consumido; required
fecha_fin_actuacion; variables_actuacion.fecha_fin_actuacion.valor_consumido; required
n_motores; variables_actuacion.n_motores.valor_consumido; required
convenio_ahorro_kwh; variables_actuacion.convenio.ahorro_kwh.valor_consumido; optional
convenio_fecha_firma; variables_actuacion.convenio.fecha_firma.valor_consumido; optional
ficha_cumplimentada_firmada; variables_actuacion.ficha_cumplimentada.firmada.valor_consumido; optional
anio_finalizacion; atributos_agrupacion.anio_finalizacion; optional
sector; atributos_agrupacion.sector; optional
ccaa; atributos_agrupacion.ccaa; optional
verificador_id; atributos_agrupacion.verificador_id; optional
veredicto; evaluacion.veredicto; required
fecha_evaluacion; evaluacion.evaluado_en; required
hash_reglas; evaluacion.hash_reglas; required
ahorro_total; calculo.total; required
ahorro_total_cae; calculo.total_cae; required
ahorro_provisional; calculo.provisional; optional
motivo_no_calculo; calculo.motivo_no_calculo; optional
interpretaciones_aplicadas; interpretaciones_aplicadas; optional
carencias_evaluacion; evaluacion.carencias; optional
observaciones; observaciones; optional
subsanaciones; subsanaciones; optional
estado_ciclo; ciclo.estado_ciclo; required
estado_plataforma; ciclo.estado_plataforma; optional
"""

UNIT = """
num_serie_motor; variables.num_serie_motor.valor_consumido; required
num_serie_variador; num_serie_variador; required
tipo_equipo_accionado; variables.tipo_equipo_accionado.valor_consumido; required
regimen_previo; variables.regimen_previo.valor_consumido; required
PM; variables.PM.valor_consumido; required
N1; variables.N1.valor_consumido; required
N2; variables.N2.valor_consumido; required
h_antes; variables.h_antes.valor_consumido; required
h_despues; variables.h_despues.valor_consumido; required
P_prom; variables.P_prom.valor_consumido; optional
perdidas_declaradas_variador; variables.perdidas_declaradas_variador.valor_consumido; optional
PM_evidencia; variables.PM.tipo_evidencia; optional
N2_evidencia; variables.N2.tipo_evidencia; optional
N2_interpretacion; variables.N2.interpretacion; optional
h_despues_interpretacion; variables.h_despues.interpretacion; optional
registro_dias; variables.registro.dias.valor_consumido; optional
registro_inicio; variables.registro.inicio.valor_consumido; optional
registro_fin; variables.registro.fin.valor_consumido; optional
registro_hash_declarado; variables.registro.hash_declarado.valor_consumido; optional
h; calculo.derivadas.h; optional
perdidas_ref_kw; calculo.derivadas.perdidas_ref_kw; optional
perdidas_ref_fuente; calculo.fuentes.perdidas_ref_kw; optional
p; calculo.derivadas.p; optional
ahorro_unidad; calculo.salida; optional
control_FIS_01; calculo.controles.FIS-01; optional
control_FIS_02; calculo.controles.FIS-02; optional
interpretaciones_unidad; calculo.interpretaciones; optional
motivo_no_calculo_unidad; calculo.motivo_no_calculo; optional
"""

#: Names that a serialised case has at its top.
TOP = {"codigo_identificativo_propio", "ficha", "modelo_version", "creado_en", "variables_actuacion", "atributos_agrupacion", "evaluacion", "calculo", "interpretaciones_aplicadas", "observaciones", "subsanaciones", "ciclo"}


def rows_of(text: str) -> list[tuple[str, str, bool]]:
    """(target, source, required) of each line."""
    parts = [[x.strip() for x in line.split(";")] for line in text.strip().splitlines()]
    return [(a, b, m == "required") for a, b, m in parts]


@query("""SELECT o_orderkey, 'N' || o_custkey AS titular_nif, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000)::VARCHAR END AS convenio_ahorro_kwh, CASE WHEN o_orderkey % 4 > 0 THEN printf('%.2f', o_totalprice) END AS ahorro_total,
concat_ws(',', 'version_spec', 'hash_spec', 'titular_razon_social', 'fecha_inicio_actuacion', 'fecha_fin_actuacion', 'n_motores', 'fecha_evaluacion', 'hash_reglas', CASE WHEN o_orderkey % 4 = 0 THEN 'ahorro_total' END, 'ahorro_total_cae', CASE WHEN o_orderstatus = 'P' THEN 'estado_ciclo' END) AS shortfalls FROM orders""")
def q_handoff_payload(t):
    """Serialised cases mapped to the document that is handed over, a dotted path at a time, with what must be there and isn't."""
    o = c("o_orderkey")
    used = lambda x: F.struct(x.cast("string").alias("valor_consumido"))
    document = F.to_json(
        F.struct(
            o.cast("string").alias("codigo_identificativo_propio"), F.struct(lit("S-240").alias("codigo"), lit("1.1").alias("version_ficha")).alias("ficha"), lit("1").alias("modelo_version"),
            F.struct(used(F.concat(lit("N"), "o_custkey")).alias("titular_nif"), F.when(o % 3 == 0, used(o % 1000)).alias("convenio.ahorro_kwh")).alias("variables_actuacion"),
            F.struct(F.when(o % 4 > 0, F.format_string("%.2f", "o_totalprice")).alias("total")).alias("calculo"), F.struct(lit("FIXABLE").alias("veredicto")).alias("evaluacion"),
            F.struct(F.when(c("o_orderstatus") != "P", c("o_orderstatus")).alias("estado_ciclo")).alias("ciclo"),
        )
    )
    rows = X.selected(t("orders").select("o_orderkey", document.alias("document")), "document", rows_of(CASE))
    return rows.select("o_orderkey", "payload.titular_nif", "payload.convenio_ahorro_kwh", "payload.ahorro_total", F.array_join("shortfalls", ",").alias("shortfalls"))
