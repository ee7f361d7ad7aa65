"""Vocabularies, licence policy and model families of a curated corpus."""

from __future__ import annotations

# Fixed values, in their declared order.
TASK_TYPES = [
    "geracao-criativa", "redacao-pratica", "reescrita-edicao", "resumo", "traducao", "qa-aberta", "qa-contexto", "brainstorm",
    "classificacao-extracao", "codigo", "matematica-raciocinio", "conselho-opiniao", "planejamento", "roleplay-persona", "conversa-social", "outro",
]
DOMAINS = [
    "tecnologia", "educacao", "trabalho-negocios", "saude", "direito", "ciencia", "artes-entretenimento", "financas",
    "viagens", "culinaria", "esportes", "politica-sociedade", "relacionamentos-pessoal", "jogos", "linguagem-idiomas", "geral",
]
# Licence, commercial use, redistribution, rank when copies compete.
LICENSES = [
    ("apache-2.0", True, True, 0),
    ("mit", True, True, 1),
    ("cc-by-4.0", True, True, 2),
    ("odc-by-1.0", True, True, 3),
    ("cc-by-sa-3.0", True, True, 4),
    ("cc0-1.0", True, True, 5),
    ("cc-by-nc-4.0", False, True, 6),
    ("lmsys-1m", False, False, 7),
    ("unknown", False, False, 8),
]
OTHER_LICENSE_RANK = 9
# A model name's prefix and its family; the first that fits counts.
FAMILIES = [
    ("gpt-4.1-mini", "gpt-4.1-mini"),
    ("gpt-4.1", "gpt-4.1"),
    ("gpt-4o", "gpt-4o"),
    ("gpt-4-turbo", "gpt-4-turbo"),
    ("gpt-4", "gpt-4"),
    ("gpt-3.5", "gpt-3.5-turbo"),
    ("o1-mini", "o1-mini"),
    ("o1", "o1-preview"),
]
# Status changes that an annotation may make.
TRANSITIONS = {
    "pendente_triagem": ["devolvida", "pendente_avaliacao"],
    "devolvida": ["pendente_triagem"],
    "pendente_avaliacao": ["avaliada", "escalada", "descartada"],
    "escalada": ["avaliada", "devolvida", "descartada"],
    "avaliada": [],
    "descartada": [],
}
# What a rating, and an administrator's decision, make of an annotation.
RATING_OUTCOMES = {"incorrigivel": "descartada", "borderline_admin": "escalada", "adequado": "avaliada", "excepcional": "avaliada"}
DECISION_OUTCOMES = {"aprovada": "avaliada", "devolvida": "devolvida", "descartada": "descartada"}
