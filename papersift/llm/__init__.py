"""Training-data operators: packing, quality, token files, near-duplicates, chat
formatting, HTML main text, toxicity, license scans, quality rules, benchmark
decontamination, spelling variants, exact duplicates and embedding whitening.  Nothing else in papersift imports this subpackage."""
