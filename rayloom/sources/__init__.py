"""Reading and writing COCO documents, detection lists, trajectories, vector layers and reports."""
