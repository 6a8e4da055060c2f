"""Columns of queries that are rounded to nine digits, in Spark and in SQL: sums of the same numbers in another order differ in the last ones."""

COLUMNS: dict[str, tuple[str, ...]] = {
    "a10_grouping_sets": ("mean_score", "mean_views"),
    "a11_feature_ranges": ("min_iou", "mean_iou", "max_iou", "min_covered", "mean_covered", "max_covered"),
    "a13_segment_sizes": ("mean_size", "median_size", "p90_size", "p99_size"),
    "a14_purity": ("weighted_purity",),
    "a16_weighted_jaccard": ("overlap_mass", "union_mass", "jaccard"),
    "a17_low_occupancy": ("low_mass", "factor"),
    "a19_track_summary": ("confidence",),
    "a1_class_vote": ("share",),
    "a20_frame_support": ("coverage",),
    "a21_point_vote": ("weight",),
    "a24_edge_aggregation": ("mean_diff",),
    "a26_view_overlap": ("mean_siou", "min_siou", "max_siou"),
    "a27_projection_consistency": ("mean_iou", "min_iou", "max_iou"),
    "a29_class_iou": ("iou",),
    "a31_ranking_ap": ("ap",),
    "a32_voc_ap": ("ap",),
    "a34_threshold": ("threshold", "precision", "recall"),
    "a35_colour_statistics": ("mean_x", "mean_square_x", "dev_x"),
    "a37_mask_confidence": ("confidence",),
    "a39_threshold_summary": ("good_rate", "good_score"),
    "a3_mean_best_iou": ("mean_iou",),
    "a43_z_with_fallback": ("z",),
    "a44_multi_view_support": ("mean_support", "best_support"),
    "a4_label_consensus": ("label_consensus_score", "label_conflict_score", "label_margin", "label_entropy", "total_evidence", "top_conflict_evidence"),
    "a5_merged_consensus": ("share",),
    "a6_label_statistics": ("label_entropy", "top_label_ratio", "second_label_ratio"),
    "a7_noisy_or": ("evidence",),
    "a8_rescore": ("best", "second"),
    "a9_group_z": ("z",),
    "e10_average_recall": ("ar", "top_recall"),
    "e13_second_classes": ("ap", "ap50", "ap25"),
    "e15_box_ap": ("ap",),
    "e7_closed_form_ap": ("ap",),
    "e9_average_precision": ("ap", "ap50", "ap25"),
    "e9_averages": ("ap", "ap50", "ap25"),
    "f11_graph_quality": ("quality",),
    "f10_calibration": ("factor",),
    "f13_view_quality": ("quality",),
    "f21_binning": ("mean_best",),
    "f23_features": ("mean_iou_std",),
    "f29_normalised": ("nx", "ny", "nz", "red"),
    "f30_softmax_whole": ("first_p", "top_p"),
    "f40_log_metrics": ("mean_ap",),
    "f9_novelty": ("novelty",),
    "g5_combined_weights": ("weight",),
    "g5_neighbour_weights": ("weight",),
    "g6_mesh_weights": ("weight",),
    "g7_view_relations": ("support_score",),
    "g9_cluster_stats": ("mean_weight",),
    "geo_dominant_bin": ("share",),
    "geo_depth_relation": ("median_error", "p90_error", "consistent_ratio", "inside_consistent_ratio", "conflict_ratio", "inside_conflict_ratio"),
    "geo_mutual_visible": ("visible_ab", "visible_ba", "inside_ab", "inside_ba", "visible_iou", "visible_containment", "depth_consistency", "mask_consistency"),
    "geo_shape_features": ("linearity", "planarity", "scattering", "residual", "aspect", "density"),
    "geo_segment_profile": ("cx", "cy", "cz", "r", "g", "b_", "nx", "ny", "nz"),
    "geo_segment_stats": ("cx", "cy", "cz", "x1", "x2", "y1", "y2", "z1", "z2"),
    "j11_dimension": ("mean_score",),
    "j15_amounts": ("distance",),
    "j15_huber": ("distance",),
    "o7_running_sum": ("running",),
    "q11_oracle_recall": ("recall25", "recall50", "class_recall50", "mean_iou"),
    "q12_methods": ("mean_size", "weighted_purity"),
    "q15_applied_audit": ("hit_rate", "mean_precision", "mean_coverage"),
    "q17_run_comparison": ("first_score", "last_score", "delta"),
    "q18_sweep": ("mean_score", "mean_iou"),
    "q20_actions": ("mean_score",),
    "q21_refined_candidates": ("score",),
    "q2_error_report": ("mean_score",),
    "q3_semantics": ("first_agrees", "last_agrees", "best_agrees"),
    "v8_interpolation": ("z_interpolated",),
}

#: Columns whose SQL type is wider than Spark's: sums of whole numbers, and decimal literals.
CASTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "a14_purity": ("BIGINT", ("mixed_points",)),
    "a15_partition_overlap": ("BIGINT", ("split_reference_points", "point_count", "merged_compared_points")),
    "a5_merged_consensus": ("BIGINT", ("n",)),
    "a6_label_statistics": ("BIGINT", ("label_vote_count",)),
    "e4_outcomes": ("BIGINT", ("instances",)),
    "f28_clamped_boxes": ("DOUBLE", ("ax", "ay", "bx", "by_")),
    "f2_score_modes": ("DOUBLE", ("uniform_score",)),
    "f5_rule_lookup": ("DOUBLE", ("factor",)),
    "g13_refinement": ("BIGINT", ("points",)),
    "g14_partition_outcomes": ("BIGINT", ("nodes",)),
    "geo_dominant_bin": ("BIGINT", ("kept",)),
    "q12_methods": ("BIGINT", ("max_size",)),
    "q21_refined_candidates": ("BIGINT", ("points",)),
    "q7_unreliable": ("BIGINT", ("points",)),
}
