"""sightline.functions"""
