"""A small synthetic corpus of dossiers: page texts and table rows."""

COVER = """PROCESSO NUP 64136.000123/2026-11
ASSUNTO: Requisição 21/2026- Almox Cmdo (Aquisição de material)
INTERESSADO: 9º B Sup
Órgão de Origem: 9º Gpt Log Data da Criação: 01/02/2026
Classificação: 052.12
PEÇAS PROCESSUAIS
1- Capa (a)
2- Requisição
3- Nota antiga (c)
4- 123
Legenda: (c) desentranhado
9- Fora da lista"""
REQUISITION = """Req nº 21-Almox/9º Gpt Log
Do: FISC ADM/9º B Mnt
Ao Sr Ordenador de Despesas
NUP: 64136.000123/2026-11
Assunto: Aquisição de Material Esportivo
Tipo de Empenho: Global
Empresa: ACME LTDA – CNPJ: 12.345.678/0001-90
NC 2026NC000343, de 05/02/2026, do DGO, ND 339030, PI E6SUPLJA3RR, PTRES 171397, UGR 160504, FONTE 1000000000
PE 90004/2025, UASG 160142 (GER)
MATERIAL a ser ADQUIRIDO: P. UNT R$ TOTAL"""
TERMINAL = """DEMONSTRA-DIARIO
DOCUMENTO WEB : 2026NC000343
NUMERO : 2026RO000273
DATA EMISSAO : 05FEV26
UG/GESTAO EMITENTE : 160502 / 00001 - DEPARTAMENTO DE ENGENHARIA E CONSTRUCAO - GESTOR
UG/GESTAO FAVORECIDA : 160136 / 00001 - 9 GRUPAMENTO LOGISTICO
OBSERVACAO
EMPENHO ATE 30JUN26
LANCADO POR X
001 301203                                    2.000,00
          1  232180 1021000000 339030 167504 E3PCFSCDEGE
002 301203                                    2.000,00
          1  232180 1021000000 339030 167504 E3PCFSCDEGE
003 301203                                      500,00
          1  232180 1021000000 339000 167504 E3PCFSCDEGE"""
SICAF = """DADOS DO FORNECEDOR
CNPJ: 12.345.678/0001-90
Razão Social: ACME LTDA
Nome Fantasia: ACME
Situação do Fornecedor: Credenciado
Vencimento do Cadastro: 31/12/2026
Porte da Empresa: ME
Ocorrência: Nada Consta
Impedimento de Licitar: Nada Consta
Ocorrências Impeditivas indiretas: Nada Consta
Vínculo com "Serviço Público": Nada Consta
Receita Federal e PGFN Validade: 20/07/2026 Automática
FGTS Validade: 19/02/2026 Automática
Emitido em: 10/02/2026"""
CADIN = """CADIN Consulta Contratante Créditos não quitados
CNPJ: 12.345.678/0001-90
Situação para a Esfera Federal: REGULAR
Emissão em 10/02/2026"""
CONSOLIDATED = """Consulta Consolidada de Pessoa Jurídica
Resultado
Consulta realizada em: 10/02/2026
Razão Social: ACME LTDA
CNPJ: 12.345.678/0001-90
Órgão Gestor: TCU
Cadastro: Licitantes Inidôneos
Resultado da consulta: Nada Consta
Órgão Gestor: CNJ
Cadastro: CNIA - Cadastro Nacional de Condenações
por Improbidade
Resultado da consulta: Nada Consta
"""
DISPATCH = """Despacho Nº 324-Fisc Adm/CAF/Cmdo 9º Gpt Log
Campo Grande, MS, 9 de fevereiro de 2026
Assunto: aprovação da requisição

1. APROVO e ENCAMINHO.

FULANO DE TAL - TC
Ordenador de Despesas
assinado digitalmente"""
STANDARD = """Nota de Crédito Nº 2026NC000276 da UG 160073
UG EMITENTE     160073
DATA EMISSÃO    12/01/2026
VALOR TOTAL     9.000,00
DESCRIÇÃO       Atender despesas. Prazo de empenho 27 FEV 26. Fim
DESTINO | 1 | 160136 | 1 | 171460 | 1000000000 | 339000 | 160073 | I3DAFUNADOM | 9.000,00"""
CONTRACT = """TERMO DE CONTRATO
CONTRATO DE PRESTAÇÃO DE SERVIÇOS Nº 059/2024, QUE FAZEM ENTRE SI
CONTRATANTE: UNIÃO, POR INTERMÉDIO DO COMANDO, inscrita no CNPJ 00.394.452/0001-03
CONTRATADA: LIMPA TUDO LTDA, inscrita no CNPJ 98.765.432/0001-10
UASG 160136 vigência de 01/01/2025 a 31/12/2026
valor total de R$ 12.000,00
Documento assinado digitalmente
FULANO DE TAL
Documento assinado digitalmente
BELTRANA SILVA
"""
NOTICE = "EDITAL do PREGÃO ELETRÔNICO Nº 90004/2025 com PREGOEIRO e EQUIPE DE APOIO"
FOOTER = "Este documento é peça do processo 64136.000123/2026-11 Pág 3 de 30"

PAGES = [
    *(("A", i + 1, t, "text") for i, t in enumerate((COVER, REQUISITION, TERMINAL, SICAF, CADIN, CONSOLIDATED, DISPATCH, NOTICE, FOOTER))),
    ("B", 1, "PROCESSO NUP 64136.000999/2026-22\nÓrgão de Origem: 18º B Trnp\n", "text"),
    ("B", 2, REQUISITION.replace("12.345.678/0001-90", "11.111.111/0001-11").replace("2026NC000343", "2026NC000276"), "text"),
    ("B", 3, STANDARD, "text"), ("B", 4, SICAF, "text"), ("B", 5, CONTRACT, "text"),
]
ROWS = [
    ("A", 2, 1, 0, ["ITEM", "CATMAT", "DESCRIÇÃO", "UND", "QTD", "ND/S.I.", "P. UNT", "P TOTAL"]),
    ("A", 2, 1, 1, ["1", "123456", "CHAPA DE AÇO", "KG", "6.666", "30.24", "R$ 0,30", "R$ 1.999,80"]),
    ("A", 2, 1, 2, [None, None, "GALVANIZADO", None, None, None, None, None]),
    ("A", 2, 1, 3, ["2", None, "TINTA BRANCA", "L", None, None, "R$ 2,00", "R$ 10,00"]),
    ("A", 2, 1, 4, [None, "301234", "", None, "5", None, None, None]),
    ("A", 2, 1, 5, ["TOTAL", None, None, None, None, None, None, "R$ 2.009,80"]),
    ("B", 2, 1, 0, ["12", "DESCRIÇÃO LONGA DO MATERIAL", "123456", "3", "R$ 2,00", "R$ 7,00"]),
    ("B", 2, 1, 1, ["13", "OUTRA DESCRIÇÃO BEM LONGA", "123457", "2", "R$ 2,50", "R$ 5,00"]),
]
