"""What each answer of a reviewer means, in the words that prompts carry."""

from __future__ import annotations

#: Per reviewer: what to weigh, then the meaning of every choice of every key.
GUIDES: dict[str, list[str]] = {
    "database": [
        "Weigh each submitter's class, conflicts, review status, stated cases, families and experiments, and how recent they are; read no zygosity into the text that it does not tell or clearly imply. If in doubt answer Neutral and no_information.",
    ],
    "insilico": [
        "Read every score in its own direction; a score that is not there speaks for neither side. Give numbers in the reasoning.",
    ],
    "hpo": [
        "Use nothing but the terms above. Frequencies: obligate is every case, very frequent 80-99 %, frequent 30-79 %, occasional 5-29 %, very rare 1-4 %, excluded none.",
        "Go through the organ systems that the patient's terms touch (muscle and movement, brain, development and behaviour, face, eyes, ears, skeleton, growth, heart, lungs, gut and feeding, hormones and metabolism, kidneys and genitals, blood, immunity and skin) and say of each if the gene explains it strongly, in part or not at all. A feature that the gene leaves open is unexplained, which is no contradiction.",
    ],
    "omim": [
        "Use nothing but the texts above, and take the patient's terms for all that is known. Name what matches, and which main features of the disease the patient lacks.",
    ],
    "literature": [
        "Use nothing but the abstracts above and name PMIDs. What an abstract leaves out is unknown and does not speak against the gene; shared organ systems and specific findings count most. With one plausible overlap choose Partial Fit over Not Fit.",
    ],
    "rna_gene": [
        "A splicing p of the gene up to 0.01 is strong, up to 0.1 moderate, above that mostly none; it does not tell which exon or intron is hit. An expression z of 1.5 to 3 off zero is a moderate change, of 3 or more a large one. High pLI and low o/e mean that the gene bears loss of function badly; see if the inheritance fits.",
    ],
    "rna_variant": [
        "A junction's p up to 0.01 is strong, up to 0.1 moderate. delta is observed less expected use: the p tells if a junction is off, the deltas tell how. An expression z of 1.5 to 3 off zero is a moderate change, of 3 or more a large one. An alt ratio of 0.5 is balance. More harmful than benign records inside the junction, high pLI, low o/e and a fitting inheritance raise confidence.",
    ],
}
_EXPRESSION = {
    "Moderately Decreased Expression": "z from -3 to -1.5",
    "Largely Decreased Expression": "z of -3 or lower",
    "Increased Expression": "z of 1.5 or higher",
}
_CONFIDENCE = {
    "No RNA Evidence": "no event, or one that gene and inheritance make meaningless",
    "Weak RNA Evidence": "a moderate signal, or a strong one that gene or inheritance fit badly",
    "Strong RNA Evidence": "a strong signal of an event that fits the gene's constraint and inheritance",
}
MEANINGS: dict[str, dict[str, dict[str, str]]] = {
    "database": {
        "conclusion": {
            "Against": "the submissions as a whole lean to benign or likely benign, or give no ground for harm",
            "Neutral": "too little to judge: few or vague records, or uncertain ones without detail",
            "Supporting": "they lean to pathogenic or likely pathogenic but leave doubt, as with conflicts that credible evidence settles that way, or uncertain records with telling detail",
            "Convincing": "several credible submissions agree on pathogenic or likely pathogenic by stated criteria, or detailed evidence shows it clearly",
        },
        "zygosity": {
            "homozygous": "patients or the need of two equal alleles are told",
            "compound_heterozygous": "two different alleles in trans are told",
            "heterozygous": "affected carriers of one allele or a dominant mechanism are told",
            "no_information": "none of these is told or clearly implied",
        },
    },
    "insilico": {
        "Conclusion": {
            "Weak": "scores are mostly low, contradict each other or are largely missing",
            "Moderate": "some damaging signals agree, such as CADD of 20 or more beside one good missense predictor in its damaging range",
            "Strong": "several independent predictors are clearly in their damaging ranges and next to none contradicts",
        }
    },
    "hpo": {
        "Conclusion": {
            "Not Fit": "no organ system shows a specific pattern in common; at most general findings are shared, or the gene's pattern excludes the patient's",
            "Partial Fit": "several specific features of at least one main system form a coherent pattern; other systems may stay unexplained",
            "Good Fit": "most key features over the main systems are explained, at least one system strongly, and nothing contradicts",
            "Stand-Alone Strong Evidence": "a match so specific over the main systems that it reads like a diagnosis; little of weight is unexplained",
        }
    },
    "omim": {
        "Conclusion": {
            "Impossible": "a text says that a feature is always present or required and the patient lacks it; a merely typical feature is not enough",
            "Not Fit": "overlaps are absent or general, without a pattern",
            "Partial Fit": "an important part of the features matches specifically, but main ones are missing",
            "Good Fit": "most main features match; those missing are few or minor",
            "Stand-Alone Strong Evidence": "several distinctive features match as in a diagnosis, and hardly a main one is missing",
        }
    },
    "literature": {
        "Conclusion": {
            "Not Fit": "the abstracts describe a clearly different picture, or nothing of the patient's phenotype",
            "Partial Fit": "the main organ system, the syndrome family or several features are shared, but the picture is incomplete or general",
            "Good Fit": "organ systems, age of onset and several specific features agree, and nothing written conflicts",
        }
    },
    "rna_gene": {
        "Event": {"No Signal": "neither splicing nor expression is off", "Abnormal Splicing": "the gene's splicing p is small enough for real outliers", **_EXPRESSION},
        "Conclusion": _CONFIDENCE,
    },
    "rna_variant": {
        "Event": {
            "No Signal": "splicing, expression and allele balance are as expected",
            "Exon Skipping": "a small p, and a junction past an exon gains what the exon's own junctions lose",
            "Intron Retention": "a small p, and reads run through the splice site unsplit",
            "Cryptic Splicing": "a small p, and use moves to another splice site",
            **_EXPRESSION,
            "Allele Imbalance (Alt High)": "a small allele p with an alt ratio over 0.5",
            "Allele Imbalance (Alt Low)": "a small allele p with an alt ratio under 0.5",
        },
        "Conclusion": _CONFIDENCE,
    },
}


def rubric(kind: str) -> str:
    """The lines that tell a reviewer what to weigh and when to choose what."""
    lines = [*GUIDES[kind]]
    for key, choices in MEANINGS[kind].items():
        lines += [f"{key}:", *[f"- {choice}: {meaning}." for choice, meaning in choices.items()]]
    return "\n".join(lines)
