"""DataFrame-first Spark jobs for rectangular tables: release, rules, association, matching, evaluation."""
