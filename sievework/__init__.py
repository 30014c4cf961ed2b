"""Evidence-review data jobs on Spark: identifiers, linkage, screening, identity, retrieval and PRISMA counts."""
