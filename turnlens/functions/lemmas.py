"""Verb forms: regular conjugations are built by rule, irregular forms are listed."""

from __future__ import annotations

from collections.abc import Iterable

# --- Fixed values -----------------------------------------------------------

REGULAR = [
    "abrir", "acompañar", "ayudar", "apoyar", "atender", "avanzar", "cambiar", "construir", "cumplir", "deber", "entregar", "escribir",
    "garantizar", "ganar", "hablar", "informar", "iniciar", "invertir", "llamar", "llegar", "llevar", "mejorar", "pagar", "participar",
    "permitir", "preguntar", "presentar", "recibir", "resolver", "terminar", "tomar", "trabajar", "usar", "vivir",
]
IRREGULAR = {
    "ser": "soy eres es somos son era eras éramos eran fue fueron sea sean sido siendo será serán",
    "estar": "estoy estás está estamos están estaba estaban estuvo estuvieron esté estén estado estando",
    "haber": "hay ha han hemos había habían hubo habrá haya hayan habido",
    "tener": "tengo tienes tiene tenemos tienen tenía tenían tuvo tuvieron tenga tengan tenido teniendo tendrá",
    "hacer": "hago haces hace hacemos hacen hacía hacían hizo hicieron haga hagan hecho haciendo hará",
    "decir": "digo dices dice decimos dicen decía decían dijo dijeron diga digan dicho diciendo dirá",
    "poder": "puedo puedes puede podemos pueden podía podían pudo pudieron pueda puedan podido podrá",
    "ir": "voy vas va vamos van iba iban vaya vayan ido yendo irá",
}
ENDINGS = {
    "ar": "o as a amos an aba abas ábamos aban é aste ó aron e es emos en ado ada ados adas ando aré ará aremos arán",
    "er": "o es e emos en ía ías íamos ían í iste ió ieron a as amos an ido ida idos idas iendo eré erá eremos erán",
    "ir": "o es e imos en ía ías íamos ían í iste ió ieron a as amos an ido ida idos idas iendo iré irá iremos irán",
}

# ----------------------------------------------------------------------------


def table(regular: Iterable[str] = REGULAR, irregular: dict[str, str] = IRREGULAR) -> dict[str, str]:
    """Form to lemma; listed forms before built ones."""
    built = {verb[:-2] + end: verb for verb in regular for end in ENDINGS[verb[-2:]].split()}
    listed = {form: verb for verb, forms in irregular.items() for form in forms.split()}
    return built | {verb: verb for verb in [*regular, *irregular]} | listed
