"""The data model as explicit Spark types; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields: object) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, I, L, D = StringType(), IntegerType(), LongType(), DoubleType()
IMAGE = _struct(urlImage=S, legendeImage=S)
#: A bulletin as its XML has it: images wraps the repeated element.
BULLETIN_XML = _struct(fichier=S, numero=S, date=S, rubrique=S, titre=S, auteur=S, texte=S, images=_struct(image=ArrayType(IMAGE)), contact=S)
BULLETIN = _struct(fichier=S, numero=I, date=DateType(), rubrique=S, titre=S, auteur=S, texte=S, images=ArrayType(IMAGE), contact=S)
TOKENS = _struct(mot=S, doc_id=S)
TF = _struct(mot=S, doc_id=S, tf=L)
IDF = _struct(mot=S, idft=D)
TFIDF = _struct(doc_id=S, mot=S, tf_idf=D)
STOP_WORDS = _struct(mot=S)
SUBSTITUTION = _struct(mot=S, lemme=S)
STEMS = _struct(mot=S, racine=S)
INDEX_LIST = _struct(mot=S, docs=S)
INDEX_FREQUENCY = _struct(terme=S, doc_id=S, frequence=I)
POSTINGS = _struct(field=S, term=S, doc_id=S, tf=I)
PARTIAL_DATE = _struct(j=I, m=I, a=I)
QUESTION = _struct(line_no=L, question=S)
QRELS = _struct(query_id=I, doc_id=S)
STRUCTURED_QUERY = _struct(
    target=S,
    kw_yes=ArrayType(S),
    kw_no=ArrayType(S),
    kw_op=S,
    rubriques=ArrayType(S),
    rub_op=S,
    titres=ArrayType(S),
    titre_op=S,
    date_from=PARTIAL_DATE,
    date_to=PARTIAL_DATE,
    date_on=PARTIAL_DATE,
    date_not=PARTIAL_DATE,
    images=BooleanType(),
)
