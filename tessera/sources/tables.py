"""Loading of tables, and deterministic tables derived from them by SQL that Spark and other engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORPUS_SQL = """select concat('go_', cast(o_orderkey as string)) as doc_id, o_orderkey as n,
 case o_orderkey % 5 when 0 then 'go' when 1 then 'legal' when 2 then 'judicial' when 3 then 'data' else 'scheme' end as true_vertical,
 concat('G.O.Ms.No. ', cast(o_orderkey as string), ' dated ',
  lpad(cast(extract(day from o_orderdate) as string),2,'0'),'-',lpad(cast(extract(month from o_orderdate) as string),2,'0'),'-',cast(extract(year from o_orderdate) as string), chr(10), chr(10),
  case o_orderkey % 5
   when 0 then concat('Department of School Education, Government Order. Whereas the preamble applies.', chr(10), chr(10), 'ORDER:', chr(10), '1. This order takes effect at once.', chr(10), '2. See annexure.')
   when 1 then concat('The Public Education Act, 2009', chr(10), 'Section ', cast(o_orderkey % 30 + 1 as string), '. Admission rule and regulation of this chapter.', chr(10), '(1) Every clause of the statute shall apply.')
   when 2 then concat('High Court Petition No. ', cast(o_orderkey as string), chr(10), 'FACTS: The petitioner filed a writ appeal.', chr(10), 'JUDGMENT: The court held that the respondent lost the case.')
   when 3 then concat('Annual Report. Table ', cast(o_orderkey % 9 + 1 as string), ': enrollment statistics by survey', chr(10), 'a | 10 | 20', chr(10), 'b | 30 | 40')
   else concat('Jagananna Vidya Scheme guidelines', chr(10), 'ELIGIBILITY: beneficiary application', chr(10), '- one child per family', chr(10), 'BENEFITS: assistance and implementation of the scheme') end,
  chr(10), chr(10),
  case when o_orderkey % 7 = 0 then concat('This order supersedes G.O.Ms.No. ', cast(o_orderkey - 7 as string), '. ')
       when o_orderkey % 7 = 1 then concat('It amends G.O.Ms.No. ', cast(o_orderkey - 1 as string), '. ')
       when o_orderkey % 7 = 2 then concat('As per Section ', cast(o_orderkey % 30 + 1 as string), ' of the Act. ') else '' end) as text
 from {orders}"""

#: Scored candidates, a hundred for each query whatever the size, with the metadata that scoring and reranking read.
CANDIDATES_SQL = """select cast(floor(o_orderkey / 100) as bigint) as query_id, o_orderkey as chunk_id, o_orderkey * 31 % 211 as doc_id,
 case o_orderkey % 5 when 0 then 'go' when 1 then 'legal' when 2 then 'judicial' when 3 then 'data' else 'schemes' end as vertical,
 cast(o_orderkey * 7919 % 1000 as double) / 1000 as score, cast(o_orderkey * 104729 % 1000 as double) / 1000 as bm25,
 cast(2008 + o_orderkey * 13 % 18 as int) as year,
 case o_orderkey * 3 % 7 when 0 then 'orders' when 1 then 'content' when 2 then 'annexure' when 3 then 'preamble' when 4 then 'table' when 5 then 'Order' else null end as section_type,
 case o_orderkey % 6 when 0 then 'amends,implements,amends' when 1 then 'supersedes' when 2 then 'cites,governed_by' when 3 then '' when 4 then 'supersedes,amends' else 'implements' end as relation_list,
 o_orderkey % 11 = 0 as is_superseded,
 case when o_orderkey % 13 = 0 then null else 1500000000 + o_orderkey * 37 % 2000 * 86400 end as date_issued_ts,
 case when o_orderkey % 9 = 0 then 1650000000 + o_orderkey % 100 * 1000000 else null end as effective_to_ts
 from {orders}"""


#: Results of searches with their queries, texts and payloads, a hundred for each query whatever the size.
RESULTS_SQL = """select cast(floor(o_orderkey / 100) as bigint) as query_id, o_orderkey as chunk_id,
 case cast(floor(o_orderkey / 100) as bigint) % 8 when 0 then 'latest go ms no 45 on school infrastructure' when 1 then 'rte act section 12 admission criteria' when 2 then 'amma vodi scholarship scheme benefit for students' when 3 then 'fire safety audit of classroom building'
  when 4 then 'teacher transfer and posting' when 5 then 'scheme' when 6 then 'recent procurement tender specification' else 'high court order on admission rule' end as query,
 case o_orderkey % 5 when 0 then 'go' when 1 then 'legal' when 2 then 'judicial' when 3 then 'data' else 'schemes' end as vertical,
 cast(o_orderkey * 7919 % 1000 as double) / 1000 as score,
 concat(case o_orderkey % 7 when 0 then 'The Landmark judgment is a binding precedent. ' when 1 then 'A pilot in Finland shows success. ' when 2 then 'Enrollment rose to 45.5% and 12 lakh in 2021. ' when 3 then 'This order supersedes the notification. '
   when 4 then 'The rule was replaced by a circular under the RTE Act. ' when 5 then 'National scheme with Amma Vodi scholarship and hostel. ' else 'Fire safety audit of the classroom building and toilet. ' end,
  case o_orderkey % 6 when 0 then 'Section 12 admission criteria of the high court order.' when 1 then 'The go ms no 45 on school infrastructure.' when 2 then 'Teacher transfer and posting by the commissioner.' when 3 then 'Tender specification and procurement of furniture; audit of 1,250 units.' when 4 then 'State trial of tables.' else 'None.' end) as content,
 case when o_orderkey % 13 = 0 then null else cast(2008 + o_orderkey * 13 % 18 as int) end as year,
 case o_orderkey % 4 when 0 then 'School Education' when 1 then 'Finance' when 2 then null else 'Teacher Training' end as department,
 case when o_orderkey % 3 = 0 then cast(o_orderkey % 900 as string) else null end as go_number,
 case o_orderkey % 6 when 0 then 'Constitution of India' when 1 then 'Right to Education Act' when 2 then 'RTE Rules' when 3 then null else 'Service Act' end as act_name,
 case when o_orderkey % 4 = 1 then cast(o_orderkey % 40 as string) when o_orderkey % 4 = 2 then '' else null end as section_number,
 case o_orderkey % 7 when 0 then 'Supreme Court of India' when 1 then 'High Court of the State' when 2 then 'District Court' when 3 then 'Service Tribunal' when 4 then null else 'Lok Adalat' end as court_name,
 o_orderkey * 7 % 17 as citation_count,
 case o_orderkey % 9 when 0 then 'UDISE' when 1 then 'ASER survey' when 2 then 'OECD Review' when 3 then 'Annual Report 2020' when 4 then null when 5 then 'education.gov.in' when 6 then 'ugc.ac.in' when 7 then 'unesco.org' else 'Gazette' end as source,
 case o_orderkey % 5 when 0 then 'Active' when 1 then 'ongoing pilot' when 2 then 'closed' else null end as status,
 case o_orderkey % 6 when 0 then 'https://cse.ap.gov.in/x' when 1 then 'https://iit.ac.in/p' when 2 then 'https://www.worldbank.org/r' when 3 then null else 'https://blog.example.com/y' end as url,
 case when o_orderkey % 10 = 0 then '' when o_orderkey % 10 = 1 then null else concat('Report of ', cast(2019 + o_orderkey % 8 as string)) end as title,
 case o_orderkey % 5 when 0 then 'short' when 1 then null else concat('A snippet that is long enough to be kept, with 1,', cast(100 + o_orderkey % 800 as string), ' schools in it.') end as snippet,
 case o_orderkey % 6 when 0 then 'amends,implements,amends' when 1 then 'supersedes' when 2 then 'cites,governed_by' when 3 then '' when 4 then 'superseded_by,cites' else 'implements' end as relation_list,
 case o_orderkey % 4 when 0 then 'Section 12' when 1 then 'the manual' when 2 then 'G.O.Ms.No.7' else 'annexure' end as target,
 o_orderkey % 11 = 0 as is_superseded, o_orderkey % 8 = 3 as is_neighbour,
 case when o_orderkey % 13 = 0 then null else 1500000000 + o_orderkey * 37 % 2400 * 86400 end as date_issued_ts,
 case when o_orderkey % 9 = 0 then 1650000000 + o_orderkey % 100 * 1000000 else null end as effective_to_ts
 from {orders}"""


#: Documents of the five verticals, long and short, with the sections, points and tables that their chunkers look for.
STRUCTURED_SQL = """select o_orderkey as doc_id, case o_orderkey % 5 when 0 then 'go' when 1 then 'legal' when 2 then 'judicial' when 3 then 'data' else 'scheme' end as vertical,
 case o_orderkey % 5
 when 0 then concat('Government of the State. Abstract.', chr(10), 'Sub: Schools of district ', cast(o_orderkey as string), chr(10), 'Ref: letters', chr(10), chr(10), repeat(concat('WHEREAS paragraph of preamble for ', cast(o_orderkey as string), ' is placed here at some length.', chr(10), chr(10)), cast(o_orderkey % 31 as int)),
   case when o_orderkey % 3 = 0 then '' else concat('ORDER:', chr(10)) end, case when o_orderkey % 4 = 1 then '' else 'Government, after careful examination, hereby decide.' end, chr(10),
   repeat(concat('1. The committee of ', cast(o_orderkey as string), ' shall meet and report to the head of the office.', chr(10), '(a) Minutes are kept.', chr(10)), cast(o_orderkey % 17 as int)), 'ANNEXURE', chr(10), 'List')
 when 1 then concat('The Public Act.', chr(10), repeat(concat('Section ', cast(o_orderkey % 30 as string), '. Admission', chr(10), repeat(concat('(1) Every child of ward ', cast(o_orderkey as string), ' has a place in a school near by.', chr(10), '(a) No fee is due.', chr(10)), cast(o_orderkey % 23 as int)), 'Sec. 31A Fees', chr(10), 'None.', chr(10)), cast(o_orderkey % 3 as int)),
   repeat(concat('Closing words of the act for ', cast(o_orderkey as string), chr(10), chr(10)), cast(o_orderkey % 40 as int)))
 when 2 then concat('High Court. Petition ', cast(o_orderkey as string), '.', chr(10), case when o_orderkey % 4 = 0 then '' else concat('FACTS: the teacher was moved.', chr(10), chr(10), repeat(concat('A fact about case ', cast(o_orderkey as string), ' that the court heard on that day in full.', chr(10), chr(10)), cast(o_orderkey % 29 as int)), 'ARGUMENTS: both sides spoke.', chr(10)) end,
   repeat(concat('1. The petitioner of ', cast(o_orderkey as string), ' says that the rule was not followed.', chr(10), '(ii) The respondent denies it.', chr(10)), cast(o_orderkey % 21 as int)), 'JUDGMENT: dismissed.', chr(10))
 when 3 then concat('Annual report of block ', cast(o_orderkey as string), '.', chr(10), 'Section 1: Overview', chr(10), 'Enrollment grew.', chr(10), chr(10), repeat(concat('Prose about schools of block ', cast(o_orderkey as string), ' without columns.', chr(10), chr(10)), cast(o_orderkey % 33 as int)), 'Table ', cast(o_orderkey % 9 + 1 as string), ': Enrollment by year', chr(10),
   repeat(concat('a', cast(o_orderkey % 7 as string), ' | 10 | 20', chr(10)), cast(o_orderkey % 60 as int)), 'Section 2: Findings', chr(10), 'More text.', chr(10), chr(10), chr(10), 'Figure 2: Growth', chr(10), 'The line climbs.', chr(10), 'Annexure 3: Names', chr(10), 'x', chr(10))
 else concat('Vidya Scheme of ', cast(o_orderkey as string), ' for children.', chr(10), 'ELIGIBILITY: who may ask', chr(10), repeat(concat('- a child of ward ', cast(o_orderkey as string), ' below the line who goes to school', chr(10)), cast(o_orderkey % 37 as int)), 'BENEFITS: what is given', chr(10), repeat(concat('a sum for family ', cast(o_orderkey as string), ' each month of the year', chr(10), chr(10)), cast(o_orderkey % 41 as int)),
   case when o_orderkey % 2 = 0 then concat('HOW TO APPLY: at the office.', chr(10)) else '' end) end as text
 from {orders}"""


#: The same documents with what extraction leaves behind: broken words, page marks, artifacts, variant references.
DIRTY_SQL = """select doc_id, n, concat('  GO MS No ', cast(n as string), ' and G.O.Rt.No.', cast(n % 90 as string), ' see Sec. ', cast(n % 12 as string), ' on ', cast(n % 28 + 1 as string), '/05/2024', chr(10), 'educa-', chr(10), 'tion   [Image: fig ', cast(n as string), '] <b>bold</b> data', chr(10), 'Page ', cast(n % 50 as string), chr(10), cast(n % 9 as string), ' of 40', chr(10), '- 4 -', chr(10), '## head', chr(10), 'Govemment 0rder of Andhra  Pradcsh', chr(10), chr(10), chr(10), chr(10), '|~@ 9 ^^', chr(10), text) as text from {corpus}"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-like documents (doc_id, n, true_vertical, text) with departments, sections, tables and relations."""
    return spark.sql(CORPUS_SQL, orders=load(spark, sf_dir, "orders"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY_SQL, corpus=corpus(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CANDIDATES_SQL, orders=load(spark, sf_dir, "orders"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STRUCTURED_SQL, orders=load(spark, sf_dir, "orders"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESULTS_SQL, orders=load(spark, sf_dir, "orders"))


def oracle(body: str) -> str:
    """SQL with the derived tables corpus, candidates, structured and results before a query over them."""
    parts = []
    if "corpus" in body or "dirty" in body:
        parts.append(f"corpus as ({CORPUS_SQL.format(orders='orders')})")
    if "dirty" in body:
        parts.append(f"dirty as ({DIRTY_SQL.format(corpus='corpus')})")
    if "candidates" in body:
        parts.append(f"candidates as ({CANDIDATES_SQL.format(orders='orders')})")
    if "structured" in body:
        parts.append(f"structured as ({STRUCTURED_SQL.format(orders='orders')})")
    if "results" in body:
        parts.append(f"results as ({RESULTS_SQL.format(orders='orders')})")
    if not parts:
        return body
    body = body.strip()
    return f"with {', '.join(parts)}, {body[5:]}" if body.lower().startswith("with ") else f"with {', '.join(parts)} {body}"
