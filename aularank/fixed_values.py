"""Fixed values that must equal the reference's for identical results.

FIXED VALUES: column names, aliases, word lists, prompt templates and default
texts below are reproduced as plain text, in their natural order.  They are
data, not logic.
"""

# ---- FIXED VALUES: enrolment columns -------------------------------------

# Canonical projection, in order.
CANONICAL_COLUMNS = [
    "AÑO", "TIPO_CONSTANCIA", "CURSO", "NOMBRE_DRE", "NOMBRE_UGEL",
    "USUARIO_DOCUMENTO", "NOMBRE_COMPLETO", "NIVELNEXUS",
    "APROBACION", "ID_OFERTA_FORMATIVA", "ID_GRUPO",
    "FECHA_NACIMIENTO", "ES_FOCALIZADO", "HORAS_PROGRAMA",
    "CALIFICACIONES", "PROPOSITO", "ACTIVO", "PUBLICO_OBJETIVO",
    "CURSO_CULMINADO", "EDAD",
]

REQUIRED_COLUMNS = [
    "USUARIO_DOCUMENTO", "ID_OFERTA_FORMATIVA", "CURSO",
    "APROBACION", "ACTIVO", "NIVELNEXUS", "AÑO",
]

# Optional column -> (default when the column is absent, Spark type).
OPTIONAL_COLUMNS = {
    "PORCENTAJE_AVANCE": (0.0, "double"),
    "CALIFICACIONES": (None, "double"),
    "CURSO_CULMINADO": (0, "int"),
    "NOMBRE_DRE": ("", "string"),
    "NOMBRE_UGEL": ("", "string"),
    "HORAS_PROGRAMA": (0, "int"),
    "PROPOSITO": ("", "string"),
    "NOMBRE_COMPLETO": ("", "string"),
    "PUBLICO_OBJETIVO": ("", "string"),
    "ES_FOCALIZADO": (0, "int"),
    "ID_GRUPO": ("", "string"),
    "EDAD": (None, "double"),
}

# Alias -> canonical, applied in this order, only when the alias is present and
# the canonical name is absent.
COLUMN_ALIASES = [
    ("ANIO", "AÑO"),
    ("ANO", "AÑO"),
    ("YEAR", "AÑO"),
    ("USUARIO_DOC", "USUARIO_DOCUMENTO"),
    ("DNI", "USUARIO_DOCUMENTO"),
    ("DOCUMENTO", "USUARIO_DOCUMENTO"),
    ("NOMBRE", "NOMBRE_COMPLETO"),
    ("NIVEL", "NIVELNEXUS"),
    ("DRE", "NOMBRE_DRE"),
    ("UGEL", "NOMBRE_UGEL"),
    ("ID_OFERTA", "ID_OFERTA_FORMATIVA"),
    ("OFERTA_FORMATIVA", "ID_OFERTA_FORMATIVA"),
    ("APROBADO", "APROBACION"),
    ("CULMINADO", "CURSO_CULMINADO"),
    ("HORAS", "HORAS_PROGRAMA"),
    ("CALIFICACION", "CALIFICACIONES"),
    ("RATING", "CALIFICACIONES"),
]

# Text values read as "yes" by the binary normaliser (after trim + upper).
BINARY_TRUE_WORDS = ["SI", "SÍ", "S", "TRUE", "YES", "Y", "1"]

AUDIENCE_ALL = "TODOS"

# ---- FIXED VALUES: method names and phrases ------------------------------

METHODS = ["colaborativo", "popularidad", "historial", "novedad"]
FALLBACK_METHOD = "popularidad_fallback"

METHOD_PHRASES = {
    "colaborativo": "docentes con perfil similar al tuyo lo completaron con éxito",
    "historial": "docentes de tu nivel y región lo culminaron y valoraron positivamente",
    "popularidad": "es uno de los cursos más completados y mejor calificados de la plataforma",
    "novedad": "es parte de la oferta formativa más reciente de DIFODS",
}
DEFAULT_REASON = "es relevante para tu perfil docente"
GENERIC_TEACHER_CONTEXT = "Docente de la plataforma SIFODS"

# ---- FIXED VALUES: default texts -----------------------------------------

FALLBACK_JUSTIFICATION = "Curso muy valorado por docentes de la plataforma."
NO_GENERATOR_JUSTIFICATION = (
    "Curso relevante para tu nivel educativo y región. "
    "Docentes con tu perfil lo completaron con alta valoración."
)
FAILED_GENERATOR_JUSTIFICATION = "Curso relevante para tu nivel y región educativa."
COURSE_NOT_FOUND = "Curso no encontrado"
RESPONSE_DEFAULT_COURSE = "Curso"
RESPONSE_DEFAULT_JUSTIFICATION = "Relevante para tu perfil"
NO_RATING_TEXT = "sin calificación registrada"

# ---- FIXED VALUES: prompt templates --------------------------------------

PROMPT_BASE = """
Eres el **Agente Tecnológico** de SIFODS (Sistema de Formación Docente en Servicio - DIFODS).

CONTEXTO:
{context}

PREGUNTA DEL USUARIO:
{question}

Responde de manera clara, amigable y útil.
"""

PROMPT_SIFODS = """
Eres el Asistente Tecnológico de la plataforma SIFODS (Sistema de Formación Docente en Servicio).

**TU ROL:**
Ayudar a los docentes a navegar y usar la plataforma SIFODS de manera autónoma.

**FUENTES DE INFORMACIÓN:**
- DOCENTE AL DÍA: Noticias y novedades
- CENTRO DE RECURSOS: Materiales educativos disponibles
- ASISTENCIA VIRTUAL DOCENTE: Soporte técnico y tutoriales
- CANAL DE YOUTUBE: Videos instructivos
- PREGUNTAS FRECUENTES: Dudas comunes

**PRINCIPIOS:**
1. **Claridad**: Usa lenguaje simple, evita tecnicismos innecesarios
2. **Paso a paso**: Si explicas un proceso, hazlo en pasos numerados
3. **Visual**: Cuando sea posible, describe dónde hacer clic
4. **Empático**: Los docentes pueden no ser expertos en tecnología
5. **Proactivo**: Anticipa posibles dudas relacionadas

**INSTRUCCIONES:**
- Basa tu respuesta ÚNICAMENTE en el contexto proporcionado
- Si la información no está en el contexto, indícalo claramente
- Ofrece derivar a canales de soporte si es necesario
- Usa emojis moderadamente para hacer más amigable la explicación

**FORMATO DE RESPUESTA:**
1. Respuesta directa y concisa
2. Pasos detallados (si aplica)
3. Tips adicionales
4. Referencia a dónde encontrar más información

**NO DEBES:**
- Inventar información que no esté en el contexto
- Usar jerga técnica sin explicar
- Asumir conocimientos previos avanzados
"""

PROMPT_JUSTIFICATION_SYSTEM = (
    "Eres un orientador formativo del Ministerio de Educación del Perú, "
    "experto en desarrollo profesional docente. "
    "Tu tono es cercano, directo y motivador — como un colega que conoce "
    "la realidad del aula peruana y quiere ayudar al docente a crecer. "
    "Nunca suenas corporativo ni genérico. "
    "Siempre conectas los datos concretos del curso con la situación real "
    "del docente. Escribes en español peruano natural, sin tecnicismos.\n\n"
    "EJEMPLO DE JUSTIFICACIÓN CORRECTA:\n"
    "Docentes con tu perfil en Lima lo seleccionaron como uno de sus "
    "cursos más útiles para el trabajo en aula. Con 20 horas y 91% de aprobación, "
    "es una de las formaciones más eficientes disponibles ahora mismo."
)

PROMPT_JUSTIFICATION_USER = (
    "PERFIL DEL DOCENTE:\n"
    "{docente_contexto}\n"
    "\n"
    "CURSO RECOMENDADO:\n"
    "- Nombre: {curso}\n"
    "- Duración: {horas} horas\n"
    "- Calificación promedio: {calificacion}\n"
    "- Público objetivo: {publico_objetivo}\n"
    "- Propósito del curso: {proposito}\n"
    "- Tasa de culminación: {tasa_culminacion}% de docentes lo completó\n"
    "- Tasa de aprobación: {tasa_aprobacion}%\n"
    "\n"
    "POR QUÉ SE RECOMIENDA A ESTE DOCENTE:\n"
    "{razones}\n"
    "\n"
    "TAREA:\n"
    "Escribe exactamente 2 oraciones completas (entre 40 y 60 palabras en total) "
    "que expliquen de forma personalizada y motivadora por qué este curso es valioso "
    "para ESTE docente en particular. "
    "Usa datos concretos del curso (calificación, tasa de culminación, horas) "
    "y conecta con el perfil del docente (nivel, región). "
    "La primera oración explica el valor del curso. "
    "La segunda motiva a tomarlo con un dato concreto o beneficio específico. "
    "No empieces ninguna oración con 'Este curso'. "
    "No uses comillas. No uses listas. Solo el texto directo."
)

PROMPT_ROUTER = """\
[ROL]
Eres un clasificador de intenciones para la plataforma SIFODS \
(plataforma educativa para docentes del Ministerio de Educación del Perú).

[TAREA]
Elige el candidato que mejor responde a la intención del usuario.
Considera que pueden mencionar regiones peruanas (Ancash, Puno, Cusco, Lima, etc.)
o secciones de la plataforma por su nombre coloquial.

[CONSULTA]
{query}

[CANDIDATOS]
{candidates}

[FORMATO]
Responde ÚNICAMENTE con el knowledge_base elegido. Ejemplo: kb_login_acceso
"""

HELP_NO_RESULTS = (
    "No encontré información específica sobre tu consulta en nuestros recursos.\n"
    "\n"
    "**Alternativas:**\n"
    "📧 Dejanos tu consulta: soporte@sifods.edu.pe\n"
    "📞 Llama a: (01) 615 5800 Anexo:21337\n"
    "🌐 Visita nuestra sección de ayuda: https://sifods.minedu.gob.pe/docente/canales-atencion"
)
HELP_NO_RECOMMENDATIONS = (
    "En este momento no tengo suficiente información para hacerte recomendaciones personalizadas.\n"
    "¿Te gustaría ver los cursos más populares?"
)
HELP_RECOMMENDER_UNAVAILABLE = (
    "⚠️ El sistema de recomendación no está disponible. "
    "Verifica la conexión a la base de datos o el Excel de respaldo."
)

# Response text pieces (recommendation answer).
RESPONSE_HEADER = "📚 **Cursos Recomendados para Ti:**\n\n"
RESPONSE_FOOTER = "💡 Inscríbete directamente desde tu panel de cursos en SIFODS."

# Routing decision texts.
ROUTE_REASON_HIGH = "score alto ({:.4f})"
ROUTE_REASON_LOW = "score bajo ({:.4f})"
ROUTE_REASON_TIE = "empate (diff={:.4f})"
ROUTE_REASON_OK = "score ok ({:.4f})"
ROUTE_METHOD_FAST = "embeddings ⚡ ({})"
ROUTE_METHOD_LLM = "llm 🤖 ({})"
ROUTE_METHOD_NO_INDEX = "sin_indice"

# Interaction log.
TASKS = ["sifods", "recomendacion"]
RECOMMENDATION_MESSAGE = "Recomendación (top {})"
SOURCE_RECOMMENDER = "modelo_recomendacion_hibrido"
SOURCE_NONE = "ninguna"

# Node document text.
NODE_TEXT_KEYWORDS = "Palabras clave: "
NODE_TEXT_QUESTIONS = " Preguntas que responde: "
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "

# Response text block pieces (recommendation answer), in the order they appear.
RESPONSE_ITEM_TITLE = "**{i}. {curso}**\n"
RESPONSE_ITEM_WHY = " \U0001f3af {justificacion}\n"
RESPONSE_ITEM_HOURS = " ⏱️ {horas}h  |  "
RESPONSE_ITEM_DONE = "✅ {tasa}% culminación"
RESPONSE_ITEM_RATING = "  |  ⭐ {cal}/5.0"
RESPONSE_ITEM_AUDIENCE = " \U0001f465 Dirigido a: {publico}\n"
RESPONSE_ITEM_SCORE = " \U0001f4ca Score: {score}\n\n"

# Teacher context pieces for the justification prompt.
TEACHER_CONTEXT = "Nivel educativo: {nivel}. DRE: {dre}. Ha completado {n_cul} de {n_tot} cursos (tasa personal: {tasa}%). "
TEACHER_AGE = "Edad aprox: {edad} años. "
RATING_TEXT = "{cal}/5.0"

# Novelty of a course by its age in years (newest, one, two, older).
NOVELTY_VALUES = (1.0, 0.6, 0.3, 0.1)
