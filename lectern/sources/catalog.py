"""A small demo catalogue of invented papers, for seeding and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.schema import CANDIDATES

#: (key, title, authors, categories, published, citations, velocity, abstract, sections)
PAPERS = [
    (
        "2510.31001", "Water Levels from Bridge Cameras without Calibration", ["Ines Okafor", "Tor Lindqvist"], ["cs.CV", "eess.IV"], "2025-10-14T06:20:00+00:00", 12, 2.6,
        "Town bridges already carry traffic cameras. We turn their footage into river levels that agree with gauges to four centimetres, with no survey of the site.",
        {
            "introduction": "Floods in small catchments rise within an hour, and most small rivers have no gauge. Cameras look at many of them anyway. What has kept their footage from use is calibration: somebody must measure the bank before pixels mean metres. We ask whether the bridge itself can serve as the ruler.",
            "methods": "Girders, bolts and railings repeat at sizes that building codes fix. A detector finds such repeats, and their spacing gives the scale of the image near the water line. The line itself is tracked as the boundary between two textures that move differently, so reflections and foam do not shift it.",
            "results": "At nineteen bridges and over two winters the median error against a nearby gauge was 3.8 centimetres by day and 6.1 at night. Ice on the lens caused the worst weeks. Warnings came twenty-six minutes earlier than from the closest official station upstream or downstream.",
            "conclusion": "Structures of known make can replace surveys for this purpose. Wooden bridges and culverts have no standard parts and remain open, as does fog, in which the method says that it cannot see instead of guessing.",
        },
    ),
    (
        "2509.31002", "Clinic Letters in Four Dialects: What Small Language Models Keep", ["Paulina Wirth", "Deniz Aksoy", "Hanna Roos", "Jonas Veit"], ["cs.CL"], "2025-09-30T11:45:00+00:00", 0, 0.0,
        "Language models below one billion weights can rewrite hospital letters for patients. We measure which medical facts survive when patient and doctor speak different dialects.",
        {
            "introduction": "A discharge letter is written for the next doctor, yet patients read it first. Rewriting it in plain words is a task for language models, but hospitals may not send letters to outside services. Models that fit on a ward computer are small, and small models forget. This study looks at what they forget.",
            "methods": "Nurses marked every dose, date, diagnosis and instruction in 640 letters. Each letter was rewritten by five models into four regional dialects. A second group of nurses, who had not seen the original, filled in a form from the rewritten letter alone, and the forms were compared with the marks.",
            "results": "Doses survived in 99 percent of letters and diagnoses in 97, but instructions that depend on a condition, such as stopping a drug when dizzy, survived in only 81. Dialect mattered less than sentence length: most losses happened where one long sentence became three short ones.",
            "limitations": "All letters come from two wards of internal medicine. The nurses knew that they were being studied, and a patient at home may read with less care than they did.",
            "conclusion": "Small models are ready for facts and not for conditions. Copying conditional instructions word for word, beside the plain text, closed most of the gap at no cost.",
        },
    ),
    (
        "2510.31003", "Fingers that Feel Ripeness: A Soft Gripper for Orchard Robotics", ["Marco Bellandi", "Yuki Arai"], ["cs.RO", "physics.app-ph"], "2025-10-02T17:05:00+00:00", 27, 5.2,
        "Pickers squeeze a pear to know its week. We give a soft gripper the same test, and show that robotics in orchards can harvest by firmness instead of by colour.",
        {
            "introduction": "Colour tells a camera when an apple is red and nothing about when a pear is ripe. Growers send pickers through the same rows five times for that reason. A robot that only sees must either pick too early or repeat their walk without their judgement.",
            "methods": "Each finger is a silicone tube around a second tube of air. Closing it by one millimetre and listening to the pressure for eighty milliseconds yields a curve whose slope follows the fruit's stiffness. The squeeze is an order of magnitude below the force that bruises.",
            "results": "Over 4,100 pears the gripper's firmness agreed with a laboratory press at a correlation of 0.91. Harvest by firmness left 6 percent of the fruit unsold after three weeks of storage, against 17 percent for harvest by date. A fruit takes 2.4 seconds.",
            "conclusion": "Touch belongs in the harvest and costs little. Leaves caught between finger and fruit spoil one measurement in thirty, which a second squeeze detects.",
        },
    ),
    (
        "2510.31004", "Does the Passage Say So? Auditing Retrieval Augmented Generation by Deletion", ["Chiara Novak", "Samuel Adeyemi", "Lena Fuchs"], ["cs.IR", "cs.CL"], "2025-10-09T09:10:00+00:00", 33, 7.9,
        "An answer with citations looks grounded. We delete the cited passages and ask again: in retrieval augmented generation, a third of the answers stay the same.",
        {
            "introduction": "Systems that answer with sources are trusted for their sources. Whether the answer was taken from them or from the model's memory cannot be seen in the text. If memory and passage agree, nobody is harmed; when the passage is corrected later, the answer should change and may not.",
            "methods": "For each cited answer three variants of the library are made: one without the cited passage, one in which its central figure is altered, and one in which an unrelated passage takes its place. An answer counts as grounded if it changes in the first two and not in the third.",
            "results": "Of 12,000 answers by six systems, 62 percent were grounded by this test. Long answers did worse than short ones. Asking for the quotation before the answer raised the share to 78 percent, more than any change of the retriever did.",
            "discussion": "The test needs a library that its auditor may edit, so it suits builders and not outsiders. It says nothing on whether a passage is true.",
            "conclusion": "Citations are a claim, and deletion is a way to check it. The procedure runs overnight on a single machine for a library of a million passages.",
        },
    ),
    (
        "2508.31005", "Query Plans that Remember Yesterday's Scans", ["Wei Castellanos", "Amara Diop"], ["cs.DB"], "2025-08-27T20:30:00+00:00", 8, 1.1,
        "Reports run every night over nearly the same rows. A planner that keeps the sizes it saw last time beats fresh statistics on nine of ten nightly workloads.",
        {
            "introduction": "Statistics describe a table; a report asks about a corner of it. The estimate for that corner is wrong by factors, each night anew, although the same report met the true number the night before and threw it away.",
            "methods": "Every operator writes one line at its end: a hash of what it was asked, and the rows it gave. The next plan looks up the hash with literals of dates left out. Where a line exists, its number replaces the estimate; where it has aged by more than the table has grown, it is scaled.",
            "results": "Across ten nightly workloads from three companies the total time fell by 31 percent. Nine workloads gained; one, whose dates shift a filter across a holiday, lost four percent. The lines take eleven megabytes a year.",
            "conclusion": "Memory of results is cheaper than better models of data. Reports that are written once and never again gain nothing, and should not pay for it.",
        },
    ),
]


def rows() -> list[tuple]:
    """The papers as rows of CANDIDATES; the abstract is also a section."""
    return [
        (key, title, abstract, authors, categories, at, f"https://papers.example/{key}.pdf", {"abstract": abstract, **sections}, count, velocity)
        for key, title, authors, categories, at, count, velocity, abstract, sections in PAPERS
    ]


def catalog(spark: SparkSession) -> DataFrame:
    """Five candidates with their sections."""
    return spark.createDataFrame(rows(), CANDIDATES)
